"""sources of the multi-view engine."""
