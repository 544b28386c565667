"""Ready-made configurations."""
