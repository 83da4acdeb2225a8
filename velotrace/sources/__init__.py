"""Readers and writers of pings, geometries and grids."""
