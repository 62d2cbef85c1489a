"""Column expressions: aggregates that pass over missing cells, and the parts of dates."""
