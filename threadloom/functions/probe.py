"""What a driver uses: memory and time."""

from __future__ import annotations

import resource
import time


def rss_mb() -> float:
    """Largest resident memory of this process so far, in megabytes."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


class Timer:
    """Milliseconds since its start."""

    def __init__(self) -> None:
        self.begin = time.perf_counter()

    def ms(self) -> float:
        return 1000 * (time.perf_counter() - self.begin)
