"""Column expressions: numeric rules, text cleaning and display labels."""
