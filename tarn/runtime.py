"""What a host may put in the place of clock, ids, log, metrics, locks and queues."""

from __future__ import annotations

import contextlib
import logging
import threading
import time
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field


class Locks:
    """A lock for each key, within this process."""

    def __init__(self):
        self.held: dict[str, threading.RLock] = defaultdict(threading.RLock)

    @contextlib.contextmanager
    def __call__(self, key: str) -> Iterator[None]:
        with self.held[key]:
            yield


class Metrics:
    """Counts and times by name; a host may take each as it comes."""

    def __init__(self, sink: Callable[[str, float, dict], None] | None = None):
        self.sink, self.counts, self.times = sink, defaultdict(float), defaultdict(list)

    def count(self, name: str, value: float = 1, **tags) -> None:
        self.counts[name] += value
        if self.sink:
            self.sink(name, value, tags)

    def timing(self, name: str, ms: float, **tags) -> None:
        self.times[name].append(ms)
        if self.sink:
            self.sink(name, ms, tags)


@dataclass
class Runtime:
    """now: milliseconds since the epoch; queue: takes the bookmarks of slices that are to go on elsewhere."""

    now: Callable[[], float] = lambda: time.time() * 1000
    new_id: Callable[[str], str] = lambda prefix: f"{prefix}{uuid.uuid4().hex}"
    log: logging.Logger = field(default_factory=lambda: logging.getLogger("tarn"))
    metrics: Metrics = field(default_factory=Metrics)
    lock: Callable[[str], contextlib.AbstractContextManager] = field(default_factory=Locks)
    queue: Callable[[dict], None] | None = None
