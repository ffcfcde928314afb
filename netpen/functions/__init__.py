"""Column helpers: text, numbers, times, minute-ring intervals."""
