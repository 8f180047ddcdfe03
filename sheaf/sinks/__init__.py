"""Sinks: open file formats, spreadsheets, SQLite, manifests and bundles."""
