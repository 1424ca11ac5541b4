"""Column helpers: each returns a Spark Column, none runs Python per row."""
