"""Column functions: typed casts, predicates, expressions, transforms, similarity."""
