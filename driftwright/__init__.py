"""Dataset profiling and distribution-drift assessment expressed as Spark plans."""
