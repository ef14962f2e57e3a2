"""Streams of requests and samples: windows with watermarks, evidence once, the state of a tile cache."""
