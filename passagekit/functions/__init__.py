"""Column functions: text normalisation, tokens, detection, scoring."""
