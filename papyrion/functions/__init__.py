"""Column functions: text, layout geometry, languages."""
