"""Readers and writers of slides and annotations."""
