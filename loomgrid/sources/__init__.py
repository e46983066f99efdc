"""Readers and writers: files, artifacts and their naming."""
