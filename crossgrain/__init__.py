"""Factor research and training-data operators on Spark."""
