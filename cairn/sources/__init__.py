"""Readers and writers of the binary containers."""
