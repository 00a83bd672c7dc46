"""Analytics on Spark for the tables of imaging experiments."""
