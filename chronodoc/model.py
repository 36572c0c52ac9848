"""Snapshots, options, errors, metrics and log events of a store."""

from __future__ import annotations

import logging
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

LOG = logging.getLogger("chronodoc")


@dataclass(frozen=True, order=True)
class Snapshot:
    """A point in a store's history: everything with seq <= sequence."""

    sequence: int


class StoreError(Exception):
    """Base of all errors raised on purpose."""


class UniqueViolation(StoreError):
    def __init__(self, index: str, key: str):
        super().__init__(f"unique index {index!r} already holds key {key!r}")
        self.index, self.key = index, key


class SequenceTooLow(StoreError):
    def __init__(self, required: int, current: int):
        super().__init__(f"sequence {required} required, store is at {current}")
        self.required, self.current = required, current


class UnknownIndex(StoreError):
    pass


class UnknownSnapshot(StoreError):
    pass


class InvalidRequest(StoreError):
    pass


@dataclass(frozen=True)
class LogEvent:
    """What happened, for the callback of ``StoreOptions.logger``."""

    type: str
    collection: str
    index: str | None = None
    count: int | None = None

    def to_dict(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if v is not None}


@dataclass
class StoreOptions:
    path: str
    default_scan_limit: int = 100
    logger: Callable[[LogEvent], None] | None = None


OPERATIONS = ("puts", "gets", "deletes", "scans", "indexLookups", "batches", "histories")


@dataclass
class Metrics:
    """Counters of calls. An index lookup also counts a get for each index it reads a document by."""

    counts: Counter = field(default_factory=Counter)

    def hit(self, name: str, n: int = 1) -> None:
        self.counts[name] += n

    def snapshot(self) -> dict[str, int]:
        return {k: self.counts[k] for k in OPERATIONS}

    def reset(self) -> None:
        self.counts.clear()
