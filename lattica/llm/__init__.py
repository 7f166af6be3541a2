"""Training-data operators: packing, tokens, near-duplicates, language, quality.

Nothing outside this package imports it; its queries are in ``queries``.
"""
