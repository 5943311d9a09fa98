"""Composed plans and session handling."""
