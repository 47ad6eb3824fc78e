"""Column functions: text, JSON, arrays, answers."""
