"""Stage graphs and the registered queries."""
