"""Operators for preparing training data: deduplication, decontamination, mixing, extraction, filters and fingerprints."""
