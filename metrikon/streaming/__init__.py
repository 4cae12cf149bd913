"""Quality control on streams."""
