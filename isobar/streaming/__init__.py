"""Fields as they arrive."""
