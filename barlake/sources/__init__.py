"""Readers: directories, screener pages, price feeds, reports, file inventories."""
