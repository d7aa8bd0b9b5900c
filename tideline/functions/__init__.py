"""Column expressions: constraints, session phases and buckets."""
