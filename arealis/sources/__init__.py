"""Readers and writers for the file formats a study brings."""
