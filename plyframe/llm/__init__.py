"""Training-data operators: deduplication, decontamination, extraction, mixing.

Nothing outside this folder imports it; ``registry`` lists its queries.
"""
