"""Content-addressed data on Spark: chunking, hashing, deduplication, containers, reconstruction plans and versioned catalogues."""
