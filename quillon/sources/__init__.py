"""Sources, sinks and the model over the driver's tables."""
