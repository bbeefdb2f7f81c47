"""Operators for preparing training text at scale, independent of the rest."""
