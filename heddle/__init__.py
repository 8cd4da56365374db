"""heddle: retrieval, usage analytics, keyed state and text rules as Spark DataFrame operators."""
