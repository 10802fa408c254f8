"""Contest, price and forecast analytics as plain Spark DataFrame operators."""
