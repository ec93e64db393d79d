"""Map operators on streams."""
