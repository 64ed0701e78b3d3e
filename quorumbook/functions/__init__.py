"""Column functions: voting rules, text rules and time arithmetic."""
