"""Workflows: preparation to inversion to model, and merging of tracks."""
