"""Feature families, annotations and models."""
