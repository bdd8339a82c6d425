"""Operators for training data: texts, names, duplicates, tokens. Nothing outside this subpackage imports it."""
