"""Operators over captured pages and the records extracted from them."""
