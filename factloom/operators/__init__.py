"""Operators of factloom."""
