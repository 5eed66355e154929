"""Operators that prepare text corpora for language-model training.

Self-contained: nothing outside this subpackage imports it.
"""
