"""Readers and writers: listings, headers, logs, probe documents, reports."""
