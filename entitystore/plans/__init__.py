"""Logical plans that combine several operators."""
