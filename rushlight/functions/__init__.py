"""Column builders: geometry, encodings, cameras, sensors, text."""
