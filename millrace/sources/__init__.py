"""Readers and writers of records, manifests, grounding sets and releases."""
