"""Operators of a training-data pipeline: licences, token files, deduplication,
packing, nearest neighbours, language-model scores, toxicity, mixing, personal data.

Nothing else in the library imports this subpackage.
"""
