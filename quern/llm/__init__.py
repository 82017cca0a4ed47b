"""Training-data operators: dedup, filtering, extraction, tokenising.

Nothing else in the library imports this subpackage; see ``queries.py`` for
the registered queries.
"""
