"""Column expressions: no joins, no actions, everything inside codegen."""
