"""Readers of paged documents, gold questions and files."""
