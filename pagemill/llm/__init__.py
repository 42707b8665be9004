"""Training-data operators: dedup, language, mixing, licences, HTML, tokens, search."""
