"""Column expressions: normalising texts, numbers, dates and booleans, and classifying cells."""
