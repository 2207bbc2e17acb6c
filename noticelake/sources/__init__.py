"""Reading and writing offense tables, documents and curated dimensions."""
