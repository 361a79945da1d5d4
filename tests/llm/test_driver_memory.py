"""Memory that the driver's Python has freed goes back to the system."""

import os

import pytest

from llm.common import trim


def _resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6


@pytest.mark.skipif(not os.path.exists("/proc/self/statm"), reason="needs /proc")
def test_freed_memory_is_given_back():
    before = _resident()
    # Blocks below the size that is mapped alone; some that stay keep the heap from shrinking at its end.
    held = [bytearray(b"x" * 60_000) for _ in range(4_000)]
    grown = _resident() - before
    held = held[::100]
    trim()
    assert grown > 200
    assert _resident() - before < grown / 4
