"""Operators for preparing training data: dedup, token counts, mixing, toxicity, coding, privacy, quality, sharding, decontamination."""
