"""Readers, dataset writers and typed ingestion."""
