"""Column expressions: cleaning, text, dates and binning."""
