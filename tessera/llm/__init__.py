"""Training-data operators: decontamination, language ID, URL filters, near-duplicate
joins, quality scoring, audio columns, substring dedup, LM scoring, BPE, suffix dedup.

Nothing outside this subpackage imports it.
"""
