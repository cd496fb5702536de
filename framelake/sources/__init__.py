"""Readers and writers of annotation and prediction documents."""
