"""Operators: functions ``DataFrame -> DataFrame`` with thresholds as arguments."""
