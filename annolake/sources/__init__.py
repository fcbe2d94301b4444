"""Readers and writers of annotation data sets."""
