"""Training-data operators: URL filters, near-dedup, quality, PII, language-model
scoring, chat formatting, decontamination, packing, nearest neighbours, HTML.

Nothing outside this package imports it; it can be removed as a whole.
"""
