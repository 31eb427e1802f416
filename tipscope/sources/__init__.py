"""Reading and writing trip files, lookups, documents and the chunk store."""
