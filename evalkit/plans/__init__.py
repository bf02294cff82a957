"""The query catalog: each query with its oracle in SQL where SQL can express it."""
