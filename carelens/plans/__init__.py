"""Pass chains and the query registry."""
