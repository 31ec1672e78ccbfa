"""Registered queries: derived inputs, Spark plans and their SQL counterparts."""
