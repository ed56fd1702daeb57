"""Model calls behind a small protocol; tests and re-runs use recorded answers."""
