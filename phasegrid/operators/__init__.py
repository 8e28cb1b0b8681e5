"""Operators over long tables of pixels, dates and pairs."""
