"""Scans, column resolution and release normalisation."""
