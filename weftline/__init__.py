"""Weftline: time-aligned interaction analytics and training-data jobs on Spark."""
