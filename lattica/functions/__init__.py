"""Part of lattica."""
