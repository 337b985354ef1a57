"""Plan builders: sequence patterns over sentences."""
