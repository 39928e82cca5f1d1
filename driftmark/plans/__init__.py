"""Rules and other data, and the queries over the driver's tables."""
