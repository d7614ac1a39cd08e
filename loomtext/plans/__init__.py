"""Composite plans: generation and sanitizing of records over a model seam."""
