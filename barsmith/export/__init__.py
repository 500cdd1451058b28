"""Script export."""
