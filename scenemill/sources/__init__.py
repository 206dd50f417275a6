"""Readers and writers of subtitle, script, catalogue and file tables."""
