"""Operators for building training corpora: scoring, cleaning, deduplication,
classification, extraction, decontamination and mixing of documents.

Nothing outside this subpackage imports it. ``registry`` lists its queries.
"""
