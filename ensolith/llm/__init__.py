"""Training-data operators: scoring, formatting, scanning, deduplication, decontamination, encoding.

Nothing else in the library imports this subpackage.
"""
