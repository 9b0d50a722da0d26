"""Column expressions. Those in ``color`` and ``numeric`` are SQL text, so that the same text serves any dialect."""
