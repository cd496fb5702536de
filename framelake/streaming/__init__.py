"""Stateful streams over frames of keyed objects."""
