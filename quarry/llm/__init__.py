"""Training-data operators: dedup, quality, extraction, decontamination, filters, secrets, mixing.

Nothing outside this package imports it.
"""
