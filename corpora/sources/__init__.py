"""Readers and writers: tables, corpus files, annotated XML and saved scoring runs."""
