"""Panel signal analytics on Spark: DataFrame in, DataFrame out."""
