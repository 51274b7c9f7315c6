"""Training-data operators: chat formatting, deduplication, sharding, quality
classification, tokenising, nearest neighbours, decontamination, URL filters.

Nothing else in the library imports this subpackage.
"""
