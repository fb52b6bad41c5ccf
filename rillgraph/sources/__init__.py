"""Event tables to epoch tables: routing, coalescing, forward fill, ticks, feeds."""
