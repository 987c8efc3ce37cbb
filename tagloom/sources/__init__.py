"""Readers and writers of corpus formats as DataFrame transforms."""
