"""Operators for preparing training text; nothing else in this package imports them."""
