"""Control tables as CSV files."""
