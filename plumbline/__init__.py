"""Sample analytics on Spark: DataFrame operators for labelled tabular data."""
