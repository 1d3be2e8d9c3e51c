"""Query plans over the order tables."""
