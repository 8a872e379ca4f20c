"""Column functions of the evidence domain."""
