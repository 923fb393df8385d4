"""Operators for preparing training data: quality rules, token files, near-duplicates, packing, URL
filters, language identification, HTML extraction, PII surrogates and source mixing."""
