"""Word discovery and grounding as Spark jobs: DataFrames in, DataFrames out."""
