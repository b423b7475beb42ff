"""Column functions on text, times, intervals and vectors."""
