"""Staging, as the operators of this package know it."""

from ..store import read, shared_dir, stage, unstage

__all__ = ["read", "shared_dir", "stage", "unstage"]
