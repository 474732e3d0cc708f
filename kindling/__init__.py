"""Fire-weather analytics and training-data operators on Spark."""
