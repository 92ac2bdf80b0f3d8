"""plans of the multi-view engine."""
