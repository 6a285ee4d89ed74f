"""Page-layout analytics: functions."""
