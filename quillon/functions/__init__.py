"""Quillon: functions."""
