"""Operators that prepare text corpora for training, one module each; ``queries`` registers them."""
