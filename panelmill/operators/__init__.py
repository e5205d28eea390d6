"""Operators: functions from DataFrame to DataFrame; columns and thresholds are arguments."""
