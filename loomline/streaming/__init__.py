"""Streaming of loomline."""
