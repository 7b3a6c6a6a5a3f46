"""Sources: tables, EPUB archives, PDF text layers."""
