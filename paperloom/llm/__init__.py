"""Training-data operators: decontamination, language ID, LM scoring, retrieval, dedup, secrets, URLs, token output, mixing."""
