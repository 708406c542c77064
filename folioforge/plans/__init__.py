"""Job settings that are checked once, on the driver."""
