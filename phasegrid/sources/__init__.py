"""Readers and writers of lists, headers, rasters and stacks."""
