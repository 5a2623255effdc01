"""DataFrame-to-DataFrame operators, lazy unless a model is fitted."""
