"""Joins, folds and whole-table operators."""
