"""Column builders: scalar expressions that stay inside whole-stage code generation."""
