"""Jobs and queries put together from the operators."""
