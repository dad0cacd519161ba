"""Operators for preparing language-model training data.

Nothing outside this folder imports it.  Each module holds one operator with
its general interface; ``queries.py`` binds the operators to whole tables.
"""
