"""sparksift: sensitive-content analytics expressed as Spark DataFrame transformations."""
