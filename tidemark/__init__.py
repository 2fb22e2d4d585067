"""Tidemark: tumbling sensor rollups, tiered stores with exact coverage, and read-through planning on Spark."""
