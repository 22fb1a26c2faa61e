"""Readers of files, bounded records, archives and office documents, and writers of tables."""
