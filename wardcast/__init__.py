"""Panel forecasting and decision jobs on Spark DataFrames."""
