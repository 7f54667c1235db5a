"""Readers of submissions and feature tables, writers of results."""
