"""Graph documents, their topology, the fluent builder and the compiler."""
