"""Column expressions and small driver-side math."""
