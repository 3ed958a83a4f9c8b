"""Readers and writers of image files and measurement tables."""
