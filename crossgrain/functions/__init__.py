"""Column functions: null discipline, rolling frames, cross-sectional ranks."""
