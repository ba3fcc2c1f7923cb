"""Information regions of spreadsheets, and other tabular work, on Spark."""
