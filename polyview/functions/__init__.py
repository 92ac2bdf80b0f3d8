"""functions of the multi-view engine."""
