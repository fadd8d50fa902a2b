"""Column-in, Column-out helpers: paths, text measures, language tags."""
