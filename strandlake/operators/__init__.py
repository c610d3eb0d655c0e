"""Domain operators: functions from DataFrame to DataFrame."""
