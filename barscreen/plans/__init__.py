"""User-visible queries and jobs composed from the operators."""
