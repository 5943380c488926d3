"""chronorank: temporal interaction analytics on Spark."""
