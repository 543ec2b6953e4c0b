"""Intermediate tables in the folder that all executors share: the library's own, under the name the operators use."""

from ..scratch import kept, shared_dir

__all__ = ["kept", "shared_dir"]
