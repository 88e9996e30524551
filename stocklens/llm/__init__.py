"""Operators of a training-data pipeline over ``documents``, ``pages`` and ``benchmark``.

One module per operator; ``queries`` registers the ``opN_*`` queries and
``corpus_pipeline`` (repository top) chains four of them. Nothing else in the
library imports this package.
"""
