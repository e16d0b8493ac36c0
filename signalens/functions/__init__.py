"""Column functions: extraction UDFs and the scalar rules of the engine."""
