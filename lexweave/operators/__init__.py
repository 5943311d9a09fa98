"""Relational operators on sentence pairs, graphs, batches and losses."""
