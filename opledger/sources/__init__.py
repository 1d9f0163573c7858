"""Readers and writers of binary formats, and codecs of single values."""
