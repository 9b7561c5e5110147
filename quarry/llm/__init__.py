"""Operators for preparing training text at scale. Nothing else in quarry imports this subpackage."""
