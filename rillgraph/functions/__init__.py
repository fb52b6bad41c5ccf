"""Node kinds: kernels, cutoffs, column expressions and their registry."""
