"""Column-level building blocks: text normalisation, lookups, skew-safe helpers."""
