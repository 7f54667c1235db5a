"""Column functions: text primitives, statistics of arrays, vectors, cleaning."""
