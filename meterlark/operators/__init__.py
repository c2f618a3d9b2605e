"""The reports: DataFrame in, DataFrame out."""
