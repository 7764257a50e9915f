"""Training-data operators: filters, extraction, packing, near-duplicates, tokenisation.

Nothing outside this package imports it; the package can be deleted as a whole.
"""
