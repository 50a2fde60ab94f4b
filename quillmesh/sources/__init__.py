"""Readers and the versioned index tables."""
