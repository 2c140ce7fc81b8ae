"""Operators of a training-data pipeline: deduplication, decontamination,
quality, fingerprints, token output and packing.  Nothing else in the library
imports this package."""
