"""Layer builders composed from the operators."""
