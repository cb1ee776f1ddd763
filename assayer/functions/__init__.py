"""Part of the assayer library."""
