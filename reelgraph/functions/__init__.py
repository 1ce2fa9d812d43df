"""Column builders: vector arithmetic, text clean-up and media predicates."""
