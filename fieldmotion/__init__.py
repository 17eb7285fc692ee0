"""Player-tracking analytics as Spark jobs: DataFrame in, DataFrame out."""
