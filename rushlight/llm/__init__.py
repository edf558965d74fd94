"""Training-data operators: extraction, dedup, quality, toxicity, mixing, chat windows and tokenizers."""
