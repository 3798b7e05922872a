"""placekit: building and querying a curated database of places on Spark."""
