"""Column expressions: R missing-value semantics, recodes and the t distribution."""
