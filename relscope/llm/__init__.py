"""Operators of a training-data pipeline, one module per operator.

Nothing outside this subpackage imports it.  ``queries.py`` registers one
query per operator; ``corpus_pipeline.py`` at the repository top chains five.
"""
