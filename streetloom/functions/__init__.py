"""Part of streetloom."""
