"""Operators of a training-data pipeline: near-duplicates, decontamination, substring removal,
fingerprints, token files, language, URL and toxicity filters, line dedup and source mixing."""
