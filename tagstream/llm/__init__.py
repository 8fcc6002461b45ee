"""Training-data operators: quality, dedup, decontamination, packing, language models.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
