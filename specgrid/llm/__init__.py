"""Operators for preparing text corpora for model training.

Each module holds one operator with a general interface; ``queries`` wraps the
operators as named queries over the standard tables and ``oracles`` holds SQL
for those that SQL can express. Nothing outside this package imports it.
"""
