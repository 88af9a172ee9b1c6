"""Scalar functions: alphabets, complements, CIGAR strings."""
