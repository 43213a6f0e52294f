"""DataFrame operators: history, cost, retrieval, evidence, merging, web pages, routing."""
