"""adloom: product-catalog marketing analytics as Spark DataFrame jobs."""
