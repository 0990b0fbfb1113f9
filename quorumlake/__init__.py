"""Decision-intelligence analytics as PySpark DataFrame operators."""
