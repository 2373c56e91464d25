"""Readers, the transcript assembler and writers."""
