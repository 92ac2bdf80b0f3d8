"""streaming of the multi-view engine."""
