"""Readers and source bookkeeping."""
