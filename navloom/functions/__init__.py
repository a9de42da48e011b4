"""Engine package: functions."""
