"""Readers and writers of flow tables, window tables, reports and model parameters."""
