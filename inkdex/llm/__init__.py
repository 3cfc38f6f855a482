"""Operators for preparing training corpora.

Nothing else in the library imports this subpackage; the entry module adds its
queries when it can be imported.
"""
