"""Conditional column models fitted and sampled by data-parallel jobs."""
