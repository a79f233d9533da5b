"""Whole queries: the registered catalogue, their SQL counterparts and the daily run."""
