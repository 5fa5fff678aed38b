"""Analytics operators, each a Spark DataFrame job."""
