"""Operators on free text for training corpora. Nothing outside this subpackage imports it."""
