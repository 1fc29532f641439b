"""Reports composed of the operators."""
