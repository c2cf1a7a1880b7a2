"""Script analytics on Spark: DataFrame-in, DataFrame-out operators for script text and film tables."""
