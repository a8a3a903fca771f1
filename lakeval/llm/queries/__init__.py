"""One module a registered query: production parameters and the result columns."""
