"""Evaluation items leaking into training text: BM25 retrieval with block-max WAND, then exact overlap."""

from __future__ import annotations

import math
import pickle
import uuid
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronodoc.llm.textscan import Terms, blocks, hash_terms, scan_terms
from chronodoc.session import scratch

TERM = regex.compile(r"[\p{L}\p{M}\p{N}]+")
K1, B = 1.5, 0.75
#: Words of an index term: the index is over word shingles, which ordinary prose hardly shares with an item.
SHINGLE = 5
#: Shingles of a passage; passages overlap so that the shingles of a run always lie within one passage.
PASSAGE = 96
#: Postings of a block whose largest weight is kept.
BLOCK_POSTINGS = 8
#: Items of one index, which one task builds.
ITEMS_PER_INDEX = 20_000
#: Bytes of indexes that one scan of the texts works with.
INDEX_BYTES = 1 << 30
SLACK = 1 - 1e-9


def term_list(text: str) -> list[str]:
    return TERM.findall(text.lower())


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` neighbouring term hashes."""
    out = h[: max(0, len(h) - size + 1)].copy()
    for k in range(1, size):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - size + 1 + k]
    return out


class ItemIndex:
    """Inverted BM25 index of test items over shingles of ``size`` words. Weights are divided by the item's own
    threshold, so 1 is the bar.

    The threshold of an item is the lowest BM25 score that a passage sharing one of its runs can have: the
    smallest sum of weights of distinct shingles over all its windows of ``run`` terms (over all its shingles if
    it has fewer). Retrieval of everything at or above 1 therefore misses no passage that shares a run.
    Postings and block maxima lie in flat arrays; ``items`` are (id, terms), repeated ids allowed.
    """

    def __init__(self, items: list[tuple[object, list[str]]], run: int, size: int):
        self.run, self.size = run, size
        self.overlap = run - size
        self.ids, self.terms = [i for i, _ in items], [t for _, t in items]
        n = max(1, len(self.ids))
        shingles = [shingle_hashes(hash_terms(t), size).tolist() for t in self.terms]
        average = sum(map(len, shingles)) / n
        df = Counter(g for mine in shingles for g in set(mine))
        self.hashes = np.array(sorted(df), np.uint64)
        number = {g: k for k, g in enumerate(self.hashes.tolist())}
        postings: list[list[tuple[int, float]]] = [[] for _ in number]
        width = run - size + 1
        for slot, mine in enumerate(shingles):
            weight = {}
            for g, tf in Counter(mine).items():
                idf = math.log((n - df[g] + 0.5) / (df[g] + 0.5) + 1)
                weight[g] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(mine) / average))
            spans = [mine] if len(mine) < width else (mine[a : a + width] for a in range(len(mine) - width + 1))
            least = min(sum(weight[g] for g in set(s)) for s in spans)
            for g, x in weight.items():
                postings[number[g]].append((slot, x / least))
        self.start, self.first_block = [0], [0]
        self.slot, self.weight, self.block_best = array("i"), array("d"), array("d")
        for p in postings:
            slots, weights = zip(*p, strict=True)
            self.slot.extend(slots)
            self.weight.extend(weights)
            self.block_best.extend(max(weights[a : a + BLOCK_POSTINGS]) for a in range(0, len(p), BLOCK_POSTINGS))
            self.start.append(len(self.slot))
            self.first_block.append(len(self.block_best))
        self.best = np.array([max(x for _, x in p) for p in postings])
        self.grams: dict[int, dict] = {}

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of shingle hashes, -1 where no item has the shingle."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def search(self, words: list[int]) -> list[int]:
        """Slots of all items with a score of at least 1 for a passage of these distinct words, by block-max WAND.

        Cursors over the postings are kept in item order. The pivot is the first item at which the summed
        upper bounds reach the bar; if the bounds of the blocks around it do not, all cursors up to the pivot
        jump past the nearest block end; otherwise the item is scored or the cursors before it move up to it.
        """
        start, slot, weight = self.start, self.slot, self.weight
        cursors = [[slot[start[w]], w, start[w]] for w in words]
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, w, _) in enumerate(cursors):
                bound += self.best[w]
                if bound >= SLACK:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            local, border = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else len(self.ids)
            for _, w, pos in cursors[: pivot + 1]:
                stop, at = start[w + 1], pos - (pos - start[w]) % BLOCK_POSTINGS
                while at < stop and slot[min(stop, at + BLOCK_POSTINGS) - 1] < item:
                    at += BLOCK_POSTINGS
                if at < stop:
                    local += self.block_best[self.first_block[w] + (at - start[w]) // BLOCK_POSTINGS]
                    border = min(border, slot[min(stop, at + BLOCK_POSTINGS) - 1] + 1)
            if local < SLACK:
                goal = max(border, item + 1)
            elif cursors[0][0] == item:
                score = sum(weight[pos] for at, _, pos in cursors[: pivot + 1] if at == item)
                if score >= SLACK:
                    found.append(item)
                goal = item + 1
            else:
                goal = item
            for c in cursors[: pivot + 1]:
                stop = start[c[1] + 1]
                while c[2] < stop and slot[c[2]] < goal:
                    c[2] += 1
                c[0] = slot[c[2]] if c[2] < stop else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def overlap_of(self, terms: list[str], item: int) -> tuple[int, int, int] | None:
        """(length, place in the terms, place in the item) of the longest run of terms that both share, the first of
        several by place in the terms, then in the item; None if it is shorter than a run (or than a short item)."""
        mine = self.terms[item]
        n = min(self.run, len(mine))
        if item not in self.grams:
            places = defaultdict(list)
            for a in range(len(mine) - n + 1):
                places[tuple(mine[a : a + n])].append(a)
            self.grams[item] = dict(places)
        grams, open_runs, best = self.grams[item], {}, None
        for a in range(len(terms) - n + 1):
            now = {}
            for b in grams.get(tuple(terms[a : a + n]), ()):
                length, x, y = open_runs.get(b - 1, (n - 1, a, b))
                now[b] = (length + 1, x, y)
                if best is None or (-length - 1, x, y) < (-best[0], *best[1:]):
                    best = now[b]
            open_runs = now
        return best


class LeakFinder:
    """Queries every passage of every text against several indexes in one scan of the text.

    A table of bits over the shingle hashes of all indexes of one shingle size lets through only shingles that some
    item may have; each index then looks up these few.
    """

    def __init__(self, indexes: list[ItemIndex]):
        self.sized: dict[int, list[ItemIndex]] = defaultdict(list)
        for ix in indexes:
            self.sized[ix.size].append(ix)
        self.bits = {}
        for size, own in self.sized.items():
            width = max(10, int(sum(len(ix.hashes) for ix in own) * 16).bit_length())
            table = np.zeros(1 << width, bool)
            for ix in own:
                table[(ix.hashes >> np.uint64(64 - width)).astype(np.int64)] = True
            self.bits[size] = table, np.uint64(64 - width)
        self.passages = self.searched = self.candidates = 0

    def find(self, texts: list[str]) -> list[tuple[int, object, int, int, int]]:
        """(position of the text, item id, length, place in the text, place in the item): the longest shared run of each pair."""
        out: dict[tuple, tuple] = {}
        for a, b in blocks(texts):
            scan = scan_terms(texts[a:b])
            for size, own in self.sized.items():
                hashes = shingle_hashes(scan.hashes, size)
                table, shift = self.bits[size]
                at = np.flatnonzero(table[(hashes >> shift).astype(np.int64)])
                for ix in own:
                    for i, item, (length, x, y) in self._block(scan, hashes, at, ix):
                        key, run = (a + i, ix.ids[item]), (-length, x, y)
                        out[key] = min(run, out.get(key, run))
        return [(i, item, -length, x, y) for (i, item), (length, x, y) in out.items()]

    def _block(self, scan: Terms, hashes: np.ndarray, at: np.ndarray, ix: ItemIndex) -> Iterator[tuple[int, int, tuple]]:
        step = PASSAGE - ix.overlap
        counts = np.maximum(0, np.diff(scan.bounds) - ix.size + 1)
        self.passages += int(np.maximum(1, -(-counts // step)).sum())
        word = ix.numbers(hashes[at])
        at, word = at[word >= 0], word[word >= 0]
        text_of = np.searchsorted(scan.bounds, at, "right") - 1
        place = at - scan.bounds[text_of]
        inside = place < counts[text_of]  # no shingle reaches from one text into the next
        text_of, place, word = text_of[inside], place[inside], word[inside]
        if not len(word):
            return
        # passage p of a text holds its shingles p * step .. p * step + PASSAGE - 1
        first = np.concatenate([[0], np.cumsum(np.maximum(1, -(-counts // step)))])
        own = first[text_of] + place // step
        back = (place >= step) & (place % step < PASSAGE - step)
        n = len(ix.hashes)
        key = np.unique(np.concatenate([own * n + word, (own[back] - 1) * n + word[back]]))
        passage, word = np.divmod(key, n)
        some, of = np.unique(passage, return_inverse=True)
        hot = some[np.bincount(of, ix.best[word]) >= SLACK]
        self.searched += len(hot)
        begin, end = np.searchsorted(passage, hot), np.searchsorted(passage, hot, "right")
        owner = np.searchsorted(first, hot, "right") - 1
        pairs: set[tuple[int, int]] = set()
        for a, b, i in zip(begin.tolist(), end.tolist(), owner.tolist(), strict=True):
            pairs.update((i, item) for item in ix.search(word[a:b].tolist()))
        self.candidates += len(pairs)
        have, terms = -1, []
        for i, item in sorted(pairs):
            if i != have:
                have, terms = i, TERM.findall(scan.lowered[i])
            run = ix.overlap_of(terms, item)
            if run:
                yield i, item, run


def built_indexes(items: DataFrame, item_key: str, item_text: str, run: int) -> DataFrame:
    """(block, size, bytes): pickled indexes of at most about ``ITEMS_PER_INDEX`` items each, built by the tasks in parallel
    and written to the shared folder. Null and wordless items are in none."""
    spark = items.sparkSession
    rows = items.where(F.col(item_text).isNotNull()).select(F.col(item_key).alias("id"), F.col(item_text).alias("text"))
    n = max(1, -(-rows.count() // ITEMS_PER_INDEX))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            sized: dict[int, list] = defaultdict(list)
            for i, text in held:
                if t := term_list(text):
                    sized[min(SHINGLE, run, len(t))].append((i, t))
            for size, own in sorted(sized.items()):
                made = pickle.dumps(ItemIndex(own, run, size), protocol=5)
                yield pa.RecordBatch.from_arrays([pa.array([here], pa.int32()), pa.array([size], pa.int32()), pa.array([made], pa.binary())], names=["block", "size", "made"])

        for b in batches:
            for block, i, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if block != here:
                    yield from flush()
                    here, held = block, []
                held.append((i, text))
        yield from flush()

    block = F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int").alias("block")
    path = scratch(spark, "items")
    laid = rows.select(block, "id", "text").repartition("block").sortWithinPartitions("block", "id", "text")
    laid.mapInArrow(build, "block int, size int, made binary").write.parquet(path)
    return spark.read.schema("block int, size int, made binary").parquet(path)


_FINDERS: dict[tuple, LeakFinder] = {}


def _finder(key: str, sent: list) -> LeakFinder:
    """The finder of a search, made once per Python worker."""
    if key not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[key] = LeakFinder([pickle.loads(s.value) for s in sent])
    return _FINDERS[key]


def overlaps(
    docs: DataFrame, items: DataFrame, *, run: int = 13, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "item_text"
) -> DataFrame:
    """(key, item_key, length, doc_at, item_at) of texts and items whose term sequences share ``run`` consecutive terms.

    For items with fewer terms the text must hold the item's whole sequence. ``length``, ``doc_at``, ``item_at``: the longest
    shared run in terms and where it starts in both (from 0), the first of equally long ones. One row a pair and input
    row; null, empty and wordless texts or items match nothing; items with equal texts all match.

    Plan: the item indexes are built by tasks, in blocks of items; the driver passes them on as broadcasts one by one, so that
    it never holds more than one, and a worker unpacks them once for all its tasks. The texts are scanned once without
    any shuffle for every ``INDEX_BYTES`` of indexes (about half a million items).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key), F.col(text))
    kinds = [rows.schema[0].dataType.simpleString(), items.schema[item_key].dataType.simpleString()]
    schema = f"{key} {kinds[0]}, {item_key} {kinds[1]}, length int, doc_at long, item_at int"
    passes, size = [[]], 0
    for r in built_indexes(items, item_key, item_text, run).select("made").toLocalIterator():
        if size and size + len(r["made"]) > INDEX_BYTES:
            passes.append([])
            size = 0
        size += len(r["made"])
        passes[-1].append(spark.sparkContext.broadcast(bytes(r["made"])))
    found = None
    for sent in passes:
        name = uuid.uuid4().hex

        def search(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            finder = _finder(name, sent)
            for b in batches:
                keys = b.column(0)
                for at in range(0, b.num_rows, 1024):
                    got = finder.find([t or "" for t in b.column(1).slice(at, 1024).to_pylist()])
                    if got:
                        who, found, *places = zip(*got, strict=True)
                        kept = [pa.array(x, t) for x, t in zip(places, (pa.int32(), pa.int64(), pa.int32()), strict=True)]
                        yield pa.RecordBatch.from_arrays([keys.take(pa.array([at + r for r in who])), pa.array(found), *kept], names=[key, item_key, "length", "doc_at", "item_at"])

        one = rows.mapInArrow(search, schema)
        found = one if found is None else found.unionByName(one)
    return found


def leaked_items(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(key, item_key) of ``overlaps``: which test items leaked into which texts."""
    found = overlaps(docs, items, **options)
    return found.select(*found.columns[:2])
