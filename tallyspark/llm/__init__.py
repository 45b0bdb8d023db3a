"""Operators for preparing language-model training corpora (documents, pages, benchmark).

Each module holds one operator with a general interface and the thin query ``opN_<name>``
that applies it to the whole table. Nothing outside this package imports it.
"""
