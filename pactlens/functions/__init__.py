"""Column expressions: paths, identities, decay and JSON trees."""
