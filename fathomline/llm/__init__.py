"""Operators for large text corpora: near-duplicate removal, scans, classifiers, encoding, sharding."""
