"""Scalar functions: markup scanners, text helpers, number words, tokenizers."""
