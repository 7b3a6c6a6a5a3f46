"""Operators that prepare text for training language models. Nothing else in leafmill imports this subpackage."""
