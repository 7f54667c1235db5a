"""Whole queries: how sources, functions and operators are put together."""
