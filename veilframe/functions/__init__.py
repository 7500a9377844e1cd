"""Column functions: patterns, spans, validators, text and geometry."""
