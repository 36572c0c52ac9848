"""Encoding of whole texts with a public byte-level BPE vocabulary, exactly as its library encodes them."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronodoc.llm.textscan import BLOCK, LETTER, MARK, NUMBER, OTHER, SPACE, blocks, classes, codepoints, span_hashes, unassigned

DEFAULT_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: fixed value: the pattern that cuts a text into pieces before the merges of this vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points above which a text, and bytes above which an unsplit piece, is encoded as a tree of halves.
HALVE = 2048
#: Tokens on either side of a join that are encoded again at first; doubled until both sides agree.
WINDOW = 8


class TreeEncoder:
    """Byte-level BPE of many texts at once.

    A text of more than ``HALVE`` code points is halved again and again, at places inside an unsplit piece; the halves of
    all texts of a block are encoded side by side and joined by ``join``, level by level. Halves are cut into the
    vocabulary's pieces by array operations on character classes; every distinct piece of a block is encoded once and
    equal pieces (compared character by character, not only by hash) share the ids. A piece of more than ``HALVE``
    bytes is such a tree itself. Special tokens' strings are ordinary text. ``joins`` and ``widened`` count the joins and
    the windows that had to grow.
    """

    def __init__(self, rank_lines: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_lines.splitlines())}
        self.own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece = self.own._core_bpe.encode_single_piece
        self.bytes_of = self.own.decode_single_token_bytes
        self.known: dict[str, np.ndarray] = {}
        cls = classes().copy()
        cls[cls == MARK] = OTHER  # the pattern knows letters, numbers, white space and the rest
        self.cls = cls
        self.unknown = unassigned().copy()
        self.joins = self.widened = 0

    # -- tree of halves -------------------------------------------------------------------------------

    def tree(self, data: bytes) -> list[int]:
        """Ids of one unsplit piece: encode halves, then join them."""
        if len(data) <= HALVE:
            return self.piece(data)
        middle = len(data) // 2
        return self.join(self.tree(data[:middle]), self.tree(data[middle:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the concatenation of two parts of one piece from the ids of the parts.

        The last and first tokens around the join are decoded and encoded again in a growing window until
        the window agrees with both sides: its first id must be stable next to the id before it and its last
        next to the id after it. A sequence of BPE ids is the encoding of its bytes iff every two
        neighbours encode to themselves, so agreement at both edges makes the whole sequence exact. A window
        that reaches both ends is the encoding of the whole.
        """
        size = WINDOW
        self.joins += 1
        while True:
            a, b = max(0, len(left) - size), min(len(right), size)
            middle = self.piece(b"".join(map(self.bytes_of, [*left[a:], *right[:b]])))
            fits = lambda x, y: self.piece(self.bytes_of(x) + self.bytes_of(y)) == [x, y]
            if (a == 0 or fits(left[a - 1], middle[0])) and (b == len(right) or fits(middle[-1], right[b])):
                return [*left[:a], *middle, *right[b:]]
            size *= 2
            self.widened += 1

    # -- blocks of texts ------------------------------------------------------------------------------

    def cuts(self, cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of all pieces of the texts that start at ``offsets`` (the last offset is the end)."""
        cls, n = self.cls[cp], len(cp)
        begin = np.zeros(n + 1, bool)
        begin[offsets] = True
        cut = begin[:-1].copy()
        cut[1:] |= cls[1:] != cls[:-1]
        ink = cut & (cls != SPACE)
        ink[0] = False
        ink &= ~begin[:-1]
        after = np.flatnonzero(ink)
        after = after[cls[after - 1] == SPACE]  # first inked character after white space in the same text
        joined = after[cp[after - 1] == 32]
        cut[joined] = False
        cut[after - 1] = True
        # contractions: an apostrophe that begins a piece takes fixed letters with it
        q = np.flatnonzero((cp == 39) & cut)
        q = q[(q + 1 < n)]
        q = q[~begin[q + 1]]
        one = cp[q + 1]
        two = np.where((q + 2 < n) & ~begin[np.minimum(q + 2, n)], cp[np.minimum(q + 2, n - 1)], 0)
        is_one = np.isin(one, [ord(c) for c in "stmd"])
        is_two = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for at, width in ((q[is_one], 2), (q[is_two], 3)):
            cut[at + 1] = False
            rest = at[at + width < n] + width
            cut[rest] = True
        # nothing above moves a cut across a text's border
        return np.flatnonzero(cut)

    def learn(self, cp: np.ndarray) -> None:
        """Ask the library for the class of code points that have no character in this Python's Unicode tables.

        The probe's vocabulary has the single bytes and the pairs of a letter or digit and a first byte, so the pair
        shows whether the pattern keeps the two characters in one piece.
        """
        new = np.unique(cp[self.unknown[cp]])
        if not len(new):
            return
        import tiktoken

        first = [bytes([x]) for x in range(0xC2, 0xF5)]
        ranks = {t: i for i, t in enumerate([*(bytes([x]) for x in range(256)), *(b"a" + x for x in first), *(b"1" + x for x in first)])}
        probe = tiktoken.Encoding("probe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for c in new.tolist():
            kept = [probe.encode_ordinary(x + chr(c))[0] >= 256 for x in "a1"]
            self.cls[c] = LETTER if kept[0] else NUMBER if kept[1] else OTHER
        self.unknown[new] = False

    def halves(self, text: str) -> list[str]:
        """The leaves of a text's tree: cut in the middle, or at the next place inside an unsplit piece, until short."""
        cp = codepoints(text)
        self.learn(cp)
        cls, quote = self.cls[cp], cp == 39
        inside = np.zeros(len(cp), bool)
        inside[1:] = cls[1:] == cls[:-1]
        inside[:-1] &= (cls[:-1] != SPACE) | (cls[1:] == SPACE)
        inside[-1:] &= cls[-1:] != SPACE
        for back in range(min(5, len(cp))):  # an apostrophe may take letters with it
            inside[back:] &= ~quote[: len(cp) - back]
        places, out, todo = np.flatnonzero(inside), [], [(0, len(cp))]
        while todo:
            a, b = todo.pop()
            i = np.searchsorted(places, (a + b) // 2) if b - a > HALVE else len(places)
            if i < len(places) and a < places[i] < b:
                todo += [(int(places[i]), b), (a, int(places[i]))]  # the left one first
            else:
                out.append(text[a:b])
        return out

    def encode_block(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(ids of all texts in a row; per text: number of ids, of ids of its first and of its last piece, of pieces)."""
        whole = "".join(texts)
        if not whole:
            return np.zeros(0, np.int32), *[np.zeros(len(texts), np.int64)] * 4
        cp = codepoints(whole)
        self.learn(cp)
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=offsets[1:])
        starts = self.cuts(cp, offsets)
        ends = np.append(starts[1:], len(cp))
        h = span_hashes(cp, starts, ends)
        _, first, code = np.unique(h, return_index=True, return_inverse=True)
        # exact: every piece must equal the one that stands for its hash
        width = ends - starts
        same = width == width[first][code]
        shift = np.repeat(starts[first][code] - starts, np.where(same, width, 0))
        at = np.flatnonzero(np.repeat(same, width))
        if not same.all() or not np.array_equal(cp[at], cp[at + shift]):
            first = code = np.arange(len(starts))  # two pieces of one hash: every piece for itself
        ids = []
        for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True):
            p = whole[s:e]
            got = self.known.get(p)
            if got is None:
                got = np.asarray(self.tree(p.encode("utf-8", "replace")), np.int32)
                if len(p) < 64 and len(self.known) < 500_000:  # a cache only; other pieces are encoded anew
                    self.known[p] = got
            ids.append(got)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        base = np.cumsum(size) - size
        count = size[code]
        total = np.cumsum(count)
        pick = np.arange(total[-1]) + np.repeat(base[code] - (total - count), count)
        flat = np.concatenate(ids)[pick]
        border = np.searchsorted(starts, offsets)
        pieces = np.diff(border)
        head = count[np.minimum(border[:-1], len(count) - 1)] * (pieces > 0)
        tail = count[np.maximum(border[1:] - 1, 0)] * (pieces > 0)
        return flat, np.diff(np.append(0, total)[border]), head, tail, pieces

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each); null and empty texts have none."""
        texts = [t or "" for t in texts]
        trees = [self.halves(t) if len(t) > HALVE else [t] for t in texts]
        leaves = [x for t in trees for x in t]
        got = [self.encode_block(leaves[a:b]) for a, b in blocks(leaves, BLOCK)]
        if not got:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        flat, count, head, tail, pieces = (np.concatenate(c) for c in zip(*got, strict=True))
        if len(leaves) == len(texts):
            return flat, count
        end = np.cumsum(count)
        out, sizes, i = [], [], 0
        for t in trees:
            if len(t) == 1:
                part = flat[end[i] - count[i] : end[i]]
            else:
                own = range(i, i + len(t))
                part = self._grow([Half(flat[end[k] - count[k] : end[k]].tolist(), int(head[k]), int(tail[k]), pieces[k] == 1) for k in own]).ids
            out.append(np.asarray(part, np.int32))
            sizes.append(len(part))
            i += len(t)
        return np.concatenate(out), np.array(sizes, np.int64)

    def _grow(self, level: list[Half]) -> Half:
        """Join neighbours until one is left."""
        while len(level) > 1:
            pairs = [self.join_halves(x, y) for x, y in zip(level[::2], level[1::2], strict=False)]
            level = pairs + level[len(level) - len(level) % 2 :]
        return level[0]

    def join_halves(self, left: Half, right: Half) -> Half:
        """Both sides of the cut lie in one unsplit piece: only it goes through the growing windows."""
        a = len(left.ids) - left.tail
        joint = self.join(left.ids[a:], right.ids[: right.head])
        ids = [*left.ids[:a], *joint, *right.ids[right.head :]]
        return Half(ids, len(joint) if left.single else left.head, len(joint) if right.single else right.tail, bool(left.single and right.single))


@dataclass
class Half:
    """Ids of a part of a text, how many of them are its first and its last piece's, and whether it is one piece only."""

    ids: list[int]
    head: int
    tail: int
    single: bool


_MADE: dict[int, TreeEncoder] = {}


def encoder(lines: bytes) -> TreeEncoder:
    """The encoder of a vocabulary, made once per Python worker."""
    key = hash(lines)
    if key not in _MADE:
        _MADE[key] = TreeEncoder(lines)
    return _MADE[key]


def id_lists(flat: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_documents(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", directory: str = DEFAULT_DIR, vocabulary: str = VOCABULARY, report: bool = False
) -> DataFrame:
    """(key, ids) of every row: its text's ids without special tokens, an empty list for null or empty text.

    One row out per row in, repeated rows included; ``report`` adds the batch's ``joins`` and ``widened`` windows to its first
    row (0 in others). Plan: one scan, no shuffle; the halves of all texts of a batch are encoded side by side by array
    operations, so a long text is no slower a character than short ones. The vocabulary file is read by the
    driver and travels to the workers as a broadcast of its (bounded, under 2 MB) bytes.
    """
    spark = docs.sparkSession
    lines = spark.sparkContext.broadcast(Path(directory, vocabulary).read_bytes())
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    kind = rows.schema["_k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(lines.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                before = enc.joins, enc.widened
                out = [part.column(0), id_lists(*enc.encode(part.column(1).to_pylist()))]
                names = ["_k", "ids"]
                if report:
                    for name, x in zip(("joins", "widened"), (enc.joins - before[0], enc.widened - before[1]), strict=True):
                        out.append(pa.array([x] + [0] * (part.num_rows - 1), pa.int64()))
                        names.append(name)
                yield pa.RecordBatch.from_arrays(out, names=names)

    done = rows.mapInArrow(run, f"_k {kind}, ids array<int>" + ", joins long, widened long" * report)
    return done.withColumnRenamed("_k", key)
