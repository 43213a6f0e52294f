"""Reading and writing: registries, cards, caches, upserts, providers."""
