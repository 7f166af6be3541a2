"""DataFrame → DataFrame operators: relaxation (bounds), search, balance, report."""
