"""DataFrame operators: strict-prior windows, as-of joins, ranked matches, rules, metrics."""
