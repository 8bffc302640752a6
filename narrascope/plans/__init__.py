"""Multi-step batch plans built from the operators."""
