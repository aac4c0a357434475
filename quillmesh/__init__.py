"""Record linkage as Spark plans."""
