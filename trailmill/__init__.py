"""Track, road-network and training-data operators for Spark."""
