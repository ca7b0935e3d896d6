"""Functions: special functions for thresholds, and what SQL can call."""
