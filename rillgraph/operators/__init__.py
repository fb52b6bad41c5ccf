"""Operators over epoch tables, and the engine that evaluates a graph for one key."""
