"""Scalar functions: text keys, hashes, tokenizers."""
