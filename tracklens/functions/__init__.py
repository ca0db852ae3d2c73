"""Column helpers: sizes, durations, formats, paths."""
