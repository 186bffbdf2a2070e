"""tidewheel: lazy one-dimensional typed series on Spark."""
