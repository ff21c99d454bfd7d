"""Operators for preparing language-model training corpora.

Each module holds one operator with its own general interface; ``queries``
has the thin registered queries. Nothing else in the library imports this
subpackage.
"""
