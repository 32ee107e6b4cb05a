"""Column-level building blocks: predicates, scalars, masks."""
