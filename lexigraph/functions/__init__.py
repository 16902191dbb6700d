"""Column functions: text, vectors, modes."""
