"""Raster and log views of the driver's tables, and the registered queries over them."""
