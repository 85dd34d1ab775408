"""Entity-month analytics as Spark DataFrame transformations."""
