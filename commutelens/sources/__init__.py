"""Readers, sinks and the frames derived from the star-schema tables."""
