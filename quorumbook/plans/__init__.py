"""Helpers that shape physical plans: skew, numbering and materialised tables."""
