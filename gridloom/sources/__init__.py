"""Data sources and sinks: GeoTIFF, DTED, VRT, SQLite containers, vector tiles, telemetry and log text."""
