"""Column expressions: filters, aggregates, distances."""
