"""Column expressions that stay inside whole-stage codegen."""
