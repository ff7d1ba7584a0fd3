"""Runnable jobs over the plain tables: a token index of transcripts (batch) and segment ingestion (incremental)."""
