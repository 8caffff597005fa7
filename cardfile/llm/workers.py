"""Memory of Python workers."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa

from cardfile.llm import tokens


def give_back(encoders: bool = False) -> None:
    """Returns to the system what this process has freed.

    Spark keeps Python workers for later tasks, whose peaks would otherwise add
    up beside the executor's heap. encoders: the step's next tasks use the encoders
    of `tokens`, which are kept with their memos; any other step drops them. Does
    nothing else where the C library cannot.
    """
    if not encoders:
        tokens.unload()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
