"""Operators of a training-data pipeline: encoding, dedup, scoring, filtering, decontamination."""
