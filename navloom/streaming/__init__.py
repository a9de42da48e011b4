"""Engine package: streaming."""
