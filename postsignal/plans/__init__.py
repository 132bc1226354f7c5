"""End-to-end plans built from the operators."""
