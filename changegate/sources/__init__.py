"""Readers and writers of manifests, seeds, catalog tables and the run ledger."""
