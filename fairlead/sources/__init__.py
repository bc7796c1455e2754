"""Readers, writers, named tables and the evaluation store layout."""
