"""Operators for large text corpora and logs; nothing else in the library needs them."""
