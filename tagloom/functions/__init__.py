"""Column functions: each takes and returns columns, and stays in generated code."""
