"""Column expressions: geometry, curve codes, projections, scalar helpers."""
