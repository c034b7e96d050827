"""Configuration, planning and running."""
