"""Operators for preparing language-model training data at scale.

Every operator takes and returns DataFrames; the modules named ``q_*`` hold the thin
registered queries.  Nothing outside this subpackage imports it.
"""
