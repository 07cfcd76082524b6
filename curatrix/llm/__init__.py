"""Operators for preparing large-scale training text; nothing outside this subpackage imports it."""
