"""Readers that turn documents into rows."""
