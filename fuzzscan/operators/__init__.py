"""Search operators."""
