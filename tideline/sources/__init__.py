"""Readers of provider formats."""
