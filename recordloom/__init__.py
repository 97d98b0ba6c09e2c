"""Record linkage and relational analytics expressed as Spark DataFrame plans."""
