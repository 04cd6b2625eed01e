"""Operators for large training-text corpora.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; ``queries`` derives the digest rows that
``__spark_entry__`` registers.
"""
