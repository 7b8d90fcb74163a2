"""The package's code on every executor (see ``tillwise.shipping``)."""

from tillwise.shipping import ship, shipped

__all__ = ["ship", "shipped"]
