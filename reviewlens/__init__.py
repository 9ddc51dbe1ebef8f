"""reviewlens: leakage-aware features, similarity, factors, validation and blending on Spark."""
