"""End-to-end plans that compose the operators."""
