"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it; the registered queries are in
``queries.py``.
"""
