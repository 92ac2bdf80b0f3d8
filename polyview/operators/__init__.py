"""operators of the multi-view engine."""
