"""samewise: entity resolution and corpus preparation as Spark DataFrame transformations."""
