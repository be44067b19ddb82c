"""Configuration and whole-document plans."""
