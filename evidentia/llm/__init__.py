"""Operators that prepare large text corpora for training; nothing outside this package imports it."""
