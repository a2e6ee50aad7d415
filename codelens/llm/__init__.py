"""Operators for preparing large text corpora for language-model training.

Self-contained: nothing outside this subpackage imports it.  Every operator is
a ``DataFrame -> DataFrame`` function with its own module; ``queries.py``
registers one query per operator for the driver contract.
"""
