"""Engine package: plans."""
