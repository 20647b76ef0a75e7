"""Column expressions: tile arithmetic, scalars, geometry, colour."""
