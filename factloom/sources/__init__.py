"""Sources of factloom."""
