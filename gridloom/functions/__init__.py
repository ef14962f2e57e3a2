"""Column functions: rectangles and grids, tile mathematics, text and number parsing."""
