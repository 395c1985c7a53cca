"""Rating prediction on Spark DataFrames: features, graph vectors, models, scores."""
