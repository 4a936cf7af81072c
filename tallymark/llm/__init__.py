"""Operators for building training data: each module holds one operator, ``queries`` registers them."""
