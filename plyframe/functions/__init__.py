"""Scalar functions, ranking, symmetry, diagrams, predicates."""
