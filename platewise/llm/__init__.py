"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; ``queries.py`` holds the
thin ``opN_<name>`` queries over the production tables.
"""
