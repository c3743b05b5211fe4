"""Training-data operators on documents, pages and embeddings (one module each)."""
