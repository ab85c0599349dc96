"""Which dependency tables stay in executor memory between the targets of a run.

A strategy decides what is released before a target is built, and what is
persisted for it:

* ``none``: tables are read from the store each time; nothing is persisted.
* ``speed``: what was read once stays until the run ends.
* ``autoclean``: before a target, all but its own dependencies is released; its value is not kept.
* ``preclean``: likewise, but the value just built stays for the next target.
* ``lookahead``: before a target, what no waiting target needs is released.
* ``unload``: before a target, everything is released, and nothing is persisted for it.

Persisted tables may spill to the executors' disks; a lost executor's part is
read from the store again.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame

STRATEGIES = ("none", "speed", "autoclean", "preclean", "lookahead", "unload")


class Memory:
    def __init__(self, read: Callable[[str], Any]):
        self.read, self.held, self.using = read, {}, {}
        self.lock = threading.Lock()

    def begin(self, target: str, deps: set[str], waiting_for: set[str], strategy: str) -> None:
        """Releases what the strategy gives up; what other running targets use stays."""
        with self.lock:
            keep = {"none": set(self.held), "speed": set(self.held), "autoclean": deps, "preclean": deps, "lookahead": deps | waiting_for, "unload": set()}[strategy]
            in_use = set().union(*self.using.values()) if self.using else set()
            for name in set(self.held) - keep - in_use:
                self._release(name)
            self.using[target] = set(deps)

    def get(self, name: str, strategy: str) -> Any:
        """A target's value, persisted if the strategy keeps it."""
        if strategy in ("none", "unload"):
            return self.read(name)
        with self.lock:
            if name not in self.held:
                value = self.read(name)
                self.held[name] = value.persist(StorageLevel.MEMORY_AND_DISK) if isinstance(value, DataFrame) else value
            return self.held[name]

    def built(self, target: str, strategy: str) -> None:
        """A target was built anew, so an older value of it is given up; where the strategy wants it, the new one is read in."""
        with self.lock:
            self.using.pop(target, None)
            self._release(target)
        if strategy in ("speed", "preclean", "lookahead"):
            self.get(target, strategy)

    def _release(self, name: str) -> None:
        value = self.held.pop(name, None)
        if isinstance(value, DataFrame):
            value.unpersist()

    def release_all(self) -> None:
        with self.lock:
            for name in list(self.held):
                self._release(name)
            self.using.clear()
