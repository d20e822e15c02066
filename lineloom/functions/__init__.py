"""Column functions: pure projections that stay inside code generation."""
