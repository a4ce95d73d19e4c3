"""End-to-end plans: ingest, Silver, Gold, serving, quality and monitoring."""
