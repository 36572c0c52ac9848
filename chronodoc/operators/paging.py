"""Keyset pages and opaque page tokens."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from chronodoc.model import InvalidRequest

MAX_PAGE = 1000
#: Most rows, and bytes of their JSON text, that a walk holds beyond its present page; a read takes so many times the one before.
AHEAD_ROWS, AHEAD_BYTES, AHEAD_GROWTH = 50_000, 8 << 20, 16


def page_size(n: int | None, default: int = 100) -> int:
    """1 to 1000; null means ``default``."""
    return min(MAX_PAGE, max(1, default if n is None else n))


def page_rows(rows: DataFrame, size: int, after: str | None = None, *, key: str = "id", extra: int = 1) -> DataFrame:
    """The next ``size`` + ``extra`` rows by ``key`` after the cursor; a cursor beyond the end gives none."""
    if after is not None:
        rows = rows.where(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(size + extra)


@dataclass
class Page:
    items: list[Row]
    next_cursor: str | None


def fetch_page(rows: DataFrame, size: int | None = None, after: str | None = None, *, key: str = "id") -> Page:
    """One page and the cursor of the next one, null on the last page."""
    n = page_size(size)
    got = page_rows(rows, n, after, key=key).collect()
    more = len(got) > n
    return Page(got[:n], got[n - 1][key] if more else None)


class Walk:
    """Pages of rows that do not change. Each page is the one ``fetch_page`` gives; pages that follow each other share reads.

    A first page, or one out of order, reads itself only. Each read that goes on where the one before ended takes
    more, up to ``AHEAD_ROWS`` and ``AHEAD_BYTES`` (but always a page); the bytes are found from keys and sizes before
    any payload is read.
    """

    def __init__(self, rows: DataFrame, key: str = "id"):
        self.rows, self.key = rows, key
        self._held: tuple[str | None, list[str], list[Row], bool] | None = None  # read after, keys, rows, whether they reach the end

    def page(self, size: int | None = None, after: str | None = None) -> Page:
        n = page_size(size)
        page = self._from_held(n, after)
        if page is None:
            self._held = self._read(n, after)
            page = self._from_held(n, after)
        return page

    def _covers(self, after: str | None) -> bool:
        """Whether ``after`` lies in what is held, or at its end."""
        if self._held is None:
            return False
        start, keys, _, end = self._held
        if after is None:
            return start is None
        return (start is None or after >= start) and (end or bool(keys) and after <= keys[-1])

    def _from_held(self, n: int, after: str | None) -> Page | None:
        if not self._covers(after):
            return None
        _, keys, rows, end = self._held
        i = 0 if after is None else bisect_right(keys, after)
        if len(rows) <= i + n and not end:
            return None
        got = rows[i : i + n]
        return Page(got, got[-1][self.key] if len(rows) > i + n else None)

    def _read(self, n: int, after: str | None) -> tuple[str | None, list[str], list[Row], bool]:
        ahead = n
        if after is not None and self._covers(after):
            ahead = max(n, min(AHEAD_ROWS, AHEAD_GROWTH * len(self._held[2])))
        rows = self.rows
        if ahead > n:
            size = F.octet_length(F.to_json(F.struct("*"))).alias("_bytes")
            left, fits = AHEAD_BYTES, 0
            for r in page_rows(rows.select(self.key, size), ahead, after, key=self.key).collect():
                left -= r["_bytes"]
                if left < 0:
                    break
                fits += 1
            ahead = max(n, min(ahead, fits))
        got = page_rows(rows, ahead, after, key=self.key).collect()
        return after, [r[self.key] or "" for r in got], got, len(got) <= ahead


def list_page(names: list[str], size: int = 0, after: str | None = None) -> tuple[list[str], str | None]:
    """Page of a sorted list of names; size 0 means all."""
    left = sorted(n for n in names if after is None or n > after)
    if size <= 0 or len(left) <= size:
        return left, None
    return left[:size], left[size - 1]


def _b64(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def seal(cursor: str, secret: str | None) -> str:
    """A page token: the plain cursor without a secret, else a signed envelope."""
    if not secret:
        return cursor
    mac = hmac.new(secret.encode(), cursor.encode(), hashlib.sha256).hexdigest()
    return _b64(json.dumps({"c": "v1", "v": cursor, "s": mac}, separators=(",", ":")).encode())


def unseal(token: str, secret: str | None) -> str:
    """The cursor of a token. With a secret, anything unsigned, torn or signed otherwise is refused."""
    if not secret:
        return token
    try:
        d = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
        cursor, mac = d["v"], d["s"]
        good = hmac.compare_digest(mac, hmac.new(secret.encode(), cursor.encode(), hashlib.sha256).hexdigest())
    except (ValueError, KeyError, TypeError, AttributeError):
        good = False
    if not good:
        raise InvalidRequest("page token is not valid")
    return cursor
