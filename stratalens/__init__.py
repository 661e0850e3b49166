"""Case analytics and training-data operators expressed as Spark DataFrame plans."""
