"""Operators for training-data corpora: packing, chat formatting, scans, near duplicates, search, mixing, token files.

Each module is one operator with a general interface; ``queries`` registers one query per operator over the whole tables.
Nothing outside this package imports it, except the guarded import in ``__spark_entry__`` and ``corpus_pipeline``.
"""
