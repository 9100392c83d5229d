"""Column functions: everything here is a built-in expression, inside whole-stage code generation."""
