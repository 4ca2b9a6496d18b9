"""Operators on texts for the training of language models. Nothing outside this package imports it."""
