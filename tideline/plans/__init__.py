"""Strategies and the registered queries."""
