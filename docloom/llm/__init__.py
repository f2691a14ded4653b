"""Training-data operators: dedup, decontamination, scoring, quality, privacy, mixing.

Nothing outside this subpackage imports it.
"""
