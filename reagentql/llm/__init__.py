"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Operators live in one module each
(``tokencount``, ``toxicity``, ...); ``queries`` holds the thin registered queries.
"""
