"""Capture telemetry, camera-pose and splat-table jobs written as Spark DataFrames."""
