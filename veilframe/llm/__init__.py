"""Operators that prepare training text. Nothing else in veilframe imports this subpackage."""
