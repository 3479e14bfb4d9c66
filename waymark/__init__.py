"""waymark: place, route and feed cleaning as Spark DataFrame operators."""
