"""Operators of loomline."""
