"""sparkveil: privacy and perception analytics expressed as Spark DataFrames."""
