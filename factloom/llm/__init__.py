"""Operators on text and source code for training corpora.

Nothing else in the library imports this subpackage.
"""
