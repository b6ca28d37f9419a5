"""Functions of factloom."""
