"""Iterative plans over state and edge tables."""
