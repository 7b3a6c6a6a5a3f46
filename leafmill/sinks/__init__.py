"""Sinks: EPUB archives, XHTML, reports."""
