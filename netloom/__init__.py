"""Network-flow analytics and synthesis as Spark jobs: DataFrame in, DataFrame out."""
