"""Registered queries over the standard tables, with their SQL counterparts."""
