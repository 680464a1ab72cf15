"""Intermediate tables in the folder that all executors share."""

from larder.storage import cleared, delete, fresh, shared_dir, spill

__all__ = ["cleared", "delete", "fresh", "shared_dir", "spill"]
