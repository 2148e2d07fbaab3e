"""Operators a training-data pipeline needs: token counts, quality, deduplication, packing, personal data, search, toxicity."""
