"""Context assembly analytics on Spark: chunking, retrieval, packing, history compression, replay and accounting."""
