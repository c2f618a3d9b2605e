"""Readers and writers of the logs."""
