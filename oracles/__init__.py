"""SQL texts that state each query independently of the Spark code."""
