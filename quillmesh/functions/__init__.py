"""Column functions: text normalisation, set features, string similarity."""
