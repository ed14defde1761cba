"""Area-by-year panel analytics as Spark DataFrame transformations."""
