"""Column -> Column helpers and the few Arrow functions Spark has no builtin for."""
