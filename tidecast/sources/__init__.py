"""Readers that normalise inputs to fixed schemas, and sinks."""
