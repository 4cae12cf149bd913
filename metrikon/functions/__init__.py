"""Column functions: null discipline, identifiers, geometry of heights."""
