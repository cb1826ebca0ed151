"""Plans put together from the operators, and the checked queries."""
