"""Part of the corvina engine."""
