"""Column functions: normalisation, identity and classification of values."""
