"""tarvos: corpus analytics on Spark."""
