"""Operators for preparing language-model training corpora.

Nothing outside this package imports it; its queries are registered by
``__spark_entry__.py`` only where the package is present.
"""
