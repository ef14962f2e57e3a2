"""DataFrame operators over samples, rectangles, requests and metadata."""
