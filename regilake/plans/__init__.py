"""Composed jobs: ingest, export, and the registered driver queries."""
