"""Streams that keep the evidence tables current."""
