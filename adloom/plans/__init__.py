"""Composed logical plans: whole campaigns from a catalog."""
