"""Column -> Column helpers. All are built-in expressions, so they stay inside codegen."""
