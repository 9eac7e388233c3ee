"""Operators for large training-data corpora.

Every operator is importable on its own; :mod:`eddyscale.llm.queries` holds the
registered queries and their SQL.  Nothing else in the package imports from here.
"""
