"""Column functions: text, identities, scores and times."""
