"""State ranges, boards as text, derived graphs, files, sinks."""
