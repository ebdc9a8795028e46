"""Media bitstream analytics on Spark."""
