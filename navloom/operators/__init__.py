"""Engine package: operators."""
