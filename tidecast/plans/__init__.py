"""Whole plans: stand-in inputs, registered queries with their SQL twins, daily run."""
