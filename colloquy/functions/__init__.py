"""Column expressions: text cleaning, message rules, fixed values."""
