"""Column functions: geometry of boxes and text scalars."""
