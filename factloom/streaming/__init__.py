"""Streaming of factloom."""
