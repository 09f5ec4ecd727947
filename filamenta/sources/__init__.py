"""Readers and writers of particle tables."""
