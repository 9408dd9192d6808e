"""Operators for preparing training data: deduplication, decontamination, scoring, selection, mixing."""
