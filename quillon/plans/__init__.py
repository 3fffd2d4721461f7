"""Quillon: plans."""
