"""Streams into and out of the state tables."""
