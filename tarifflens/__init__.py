"""tarifflens: price documents to versioned, queryable tables on Spark."""
