"""Column functions: arrays, JSON text, tokens and media arithmetic."""
