"""Operators for text corpora on their way to language-model training.

Each module has one operator with a general interface; ``queries`` registers the
thin queries over the supplied tables.  Nothing outside this folder imports it.
"""
