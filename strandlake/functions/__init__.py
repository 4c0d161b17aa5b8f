"""Column functions: bases, CIGAR strings, SAM fields, numbers."""
