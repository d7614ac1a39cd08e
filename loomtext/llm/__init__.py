"""Operators for preparing training data at scale.

Nothing outside this folder imports it, so it can be removed without touching the rest of the library.
"""
