"""Operators that prepare text corpora for model training.

Nothing else in the package imports this folder, and it imports nothing of the rest.
"""
