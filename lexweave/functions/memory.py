"""Memory of Python workers."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def release() -> None:
    """Gives memory that a group has freed back to the system: workers live on from task to task and would else keep
    the most that any of their groups has held."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps what it keeps
        pass
