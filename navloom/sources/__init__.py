"""Engine package: sources."""
