"""Training-data operators: filters, joins, formats and encoders for text corpora."""
