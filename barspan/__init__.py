"""Panel analytics for daily market bars, written as plain PySpark DataFrame jobs."""
