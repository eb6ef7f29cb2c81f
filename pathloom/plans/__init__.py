"""Plan-building helpers."""
