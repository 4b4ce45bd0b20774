"""Column-level building blocks: cleaning, dates, statistics."""
