"""Readers of landed dumps and the release sink."""
