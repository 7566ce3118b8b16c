"""Memory of Python workers, which live from one stage to the next."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def release() -> None:
    """Give free memory of Arrow's pool and of the C library back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def frugal(work):
    """``work``, a function over Arrow batches, in a worker that holds no free
    memory between batches nor after the last one. A worker else keeps the
    most it ever needed, and several workers share an executor's memory."""

    def run(batches):
        def read():
            for b in batches:
                yield b
                del b
                release()

        yield from work(read())
        release()

    return run
