"""Training-data operators. Nothing outside this package imports it; see ``queries`` for the registered queries."""
