"""Column functions: geodesy, projection, hexagons, time, text and geometry."""
