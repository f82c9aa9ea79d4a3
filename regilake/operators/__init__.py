"""Registry operators: lazy DataFrame -> DataFrame functions over lake rows."""
