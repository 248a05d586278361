"""Entries of a memory: stored with scope and revision, recalled by words and vectors."""
