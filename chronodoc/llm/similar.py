"""Most similar vectors for every vector: cells, bounds by angles, scan of anisotropic 4-bit codes (decoded a block at a time), exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronodoc.llm import anisotropic
from chronodoc.session import scratch

#: Vectors the index is fitted on (the index itself holds every vector): at least this many, 8 a cell where there are more cells.
SAMPLE = 32_768
#: Members of a cell are kept apart by their angle from its centre, in rings of this width (radians); the last is open.
RING, RINGS = 0.2, 8
#: Allowance for rounding in bounds by angles and single-precision cosines; lets more pairs through, never fewer.
SLACK = 1e-4
#: Most base vectors of a block and most queries of a task. A query is sent to every block it asks, so large blocks save
#: shuffling; a task holds one block (about 100 MB at most).
BLOCK, QUERIES = 131_072, 32_768
#: Least blocks of all vectors and least parts of a block's queries, so that small inputs keep all cores busy.
LEAST_BLOCKS, LEAST_PARTS = 6, 3
#: Base vectors and pairs compared at a time; bound a worker's memory, not the result.
RUN, EXACT_AT_ONCE = 2_048, 1 << 19


def valid_vectors(docs: DataFrame, dim: int = 64) -> DataFrame:
    """(id, vec, cls): unit vectors of the current versions that have ``dim`` finite elements, not all zero.

    Current: the row with the highest sequence of an id; equal sequences: the larger array; null sequences lose.
    Null ids, and null, shorter, longer, null-, NaN- or infinity-holding and all-zero embeddings give no row.
    ``cls`` is a 128-bit name of the direction, equal for copies and scaled copies (to 12 decimals).
    """
    top = F.max(F.struct("sequence", "embedding")).alias("_t")
    cur = docs.where(F.col("id").isNotNull()).groupBy("id").agg(top).select("id", F.col("_t.embedding").alias("e"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(b.column(1)), dim), False))
            if not b.num_rows:
                continue
            x = pc.fill_null(b.column(1).flatten(), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
            big = np.abs(x).max(1)
            good = np.isfinite(big) & (big > 0)
            x = x[good] / big[good, None]  # scaled first, so that squares cannot overflow
            x /= np.linalg.norm(x, axis=1)[:, None]
            named = np.round(x, 12) + 0.0
            cls = _names(named)
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * dim, pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), lists, pa.array(cls, pa.string())], names=["id", "vec", "cls"])

    return cur.mapInArrow(unit, "id string, vec array<double>, cls string")


def _names(x: np.ndarray) -> list[str]:
    """A 128-bit name of every row: two sums of mixed elements, each times an odd number of its place."""
    bits = np.ascontiguousarray(x).view(np.uint64)
    mixed = (bits ^ (bits >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    odd = np.random.default_rng(20240607).integers(0, 2**63, (2, x.shape[1]), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return [a + b for a, b in zip(*(np.char.mod("%016x", (mixed * o).sum(1, dtype=np.uint64)).tolist() for o in odd), strict=True)]


def _index(model: anisotropic.Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x = _matrix(part.column(1), model.dim)
                cell = model.nearest_cells(x, 1)[:, 0]
                codes = model.pack(model.encode(x.astype(np.float32), cell))
                error = np.linalg.norm(x - model.decode(_unpacked(codes), cell), axis=1) + 1e-5  # and single-precision sums
                angle = _angle((x * _directions(model)[cell]).sum(1))
                unit = cell * RINGS + _ring(angle)
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(unit.astype(np.int32)), pa.array(angle), packed, pa.array(error)], names=["rep", "vec", "unit", "angle", "code", "error"]
                )

    return run


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(-1, dim)


def _unpacked(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes & 15, codes >> 4], 2).reshape(len(codes), -1)


def _directions(model: anisotropic.Model) -> np.ndarray:
    """The centres in double precision, of length 1, as the bounds by angles ask for."""
    c = model.centres.astype(np.float64)
    return c / np.maximum(np.linalg.norm(c, axis=1), 1e-12)[:, None]


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _ring(angle: np.ndarray) -> np.ndarray:
    return np.minimum((angle / RING).astype(np.int64), RINGS - 1)


def _blocks(centres: np.ndarray, unit: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per unit its first block and the number of blocks it is cut into; near units of a ring share a block of at most ``size`` rows."""
    first, pieces, at = np.zeros(len(unit), np.int64), np.ones(len(unit), np.int64), 0
    todo = [np.flatnonzero(unit % RINGS == r) for r in range(RINGS)]
    while todo:
        mine = todo.pop()
        if not len(mine):
            continue
        if len(mine) == 1 or rows[mine].sum() <= size:
            first[mine] = at
            pieces[mine] = -(-rows[mine].sum() // size)
            at += int(pieces[mine[0]])
            continue
        c = centres[unit[mine] // RINGS]
        along = c @ np.linalg.svd(c - c.mean(0), full_matrices=False)[2][0]
        mine = mine[np.argsort(along, kind="stable")]
        half = int(np.clip(np.searchsorted(np.cumsum(rows[mine]), rows[mine].sum() / 2), 1, len(mine) - 1))
        todo += [mine[:half], mine[half:]]
    return first, pieces


def _ask(model: anisotropic.Model, unit: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, pieces: np.ndarray, wanted: float):
    """Rows (rep, vec) to (rep, vec, asks): every block with a unit whose angles from its centre do not exclude the wanted similarity."""
    order = np.argsort(first, kind="stable")
    cell, starts = unit[order] // RINGS, np.flatnonzero(np.diff(first[order], prepend=-1))
    reach = float(_angle(np.float64(wanted - 1e-6))) + SLACK
    # a query at angle t from the centre can reach members at angles low to high only if low - reach <= t <= high + reach
    least = np.cos(np.minimum(np.pi, high[order] + reach)) - SLACK
    most = np.cos(np.maximum(0.0, low[order] - reach)) + SLACK
    ids = [np.arange(f, f + n) for f, n in zip(first[order][starts], pieces[order][starts], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = _directions(model).astype(np.float32)
        many = max(16, min(1024, (1 << 25) // len(cell)))  # bounds the table of angles
        for b in batches:
            for at in range(0, b.num_rows, many):
                part = b.slice(at, many)
                t = (_matrix(part.column(1), model.dim).astype(np.float32) @ centres.T)[:, cell]
                asked = np.logical_or.reduceat((t >= least) & (t <= most), starts, axis=1)
                lists = [np.concatenate([ids[i] for i in np.flatnonzero(row)] or [np.empty(0, np.int64)]) for row in asked]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lists, pa.list_(pa.int32()))], names=["rep", "vec", "asks"])

    return run


def _search(model: anisotropic.Model, wanted: float, keep: int):
    """Rows (task, kind, rep, vec, unit, angle, code, error), sorted by task and kind: base vectors (0), then queries (1)."""
    wanted6 = round(wanted * 1e6)
    low32 = (1 << 32) - 1

    def answer(base: list[pa.RecordBatch], queries: pa.RecordBatch) -> pa.RecordBatch | None:
        names = pa.chunked_array([b.column(2) for b in base]).combine_chunks()
        x = np.concatenate([_matrix(b.column(3), model.dim) for b in base])
        unit, angle, error = (np.concatenate([np.asarray(b.column(i)) for b in base]) for i in (4, 5, 7))
        codes = np.stack([np.frombuffer(c, np.uint8) for b in base for c in b.column(6).to_pylist()])
        coded = model.decode(_unpacked(codes), unit // RINGS)
        place = low32 - pc.rank(names, sort_keys="ascending").to_numpy().astype(np.int64)  # larger for smaller names
        q = _matrix(queries.column(3), model.dim)
        own = pc.fill_null(pc.index_in(queries.column(2), names), -1).to_numpy()
        q32, centres = q.astype(np.float32), _directions(model)
        order = np.lexsort((angle, unit))
        runs = np.split(order, np.flatnonzero(np.diff(unit[order])) + 1)
        nearness = centres @ q.mean(0)
        runs.sort(key=lambda r: -nearness[unit[r[0]] // RINGS])
        # the best found so far per query: similarity in millionths above 32 bits of the name's place, best first
        best, at = np.full((len(q), keep), -1, np.int64), np.full((len(q), keep), -1, np.int64)
        floor = np.full(len(q), wanted6, np.int64)  # nothing of a lower similarity can get among them
        for run in runs:
            t = _angle(q @ centres[unit[run[0]] // RINGS])
            for lo in range(0, len(run), RUN):
                ci = run[lo : lo + RUN]
                reach = _angle((floor - 1) / 1e6) + SLACK
                asking = np.flatnonzero((t - angle[ci].max() <= reach) & (angle[ci].min() - t <= reach))
                step = max(1, EXACT_AT_ONCE // len(ci))
                for a in range(0, len(asking), step):
                    compare(asking[a : a + step], ci, q, q32, x, coded, error, place, own, floor, best, at)
        qi, turn = np.nonzero(best >= 0)
        if not len(qi):
            return None
        sims = (best[qi, turn] >> 32) / 1e6
        return pa.RecordBatch.from_arrays([queries.column(2).take(pa.array(qi)), names.take(pa.array(at[qi, turn])), pa.array(sims)], names=["a", "b", "sim"])

    def compare(asking, ci, q, q32, x, coded, error, place, own, floor, best, at) -> None:
        # a coded vector lies within its error of the true one, so no pair that could be among the best is left out
        near = q32[asking] @ coded[ci].T >= ((floor[asking] - 1) / 1e6)[:, None] - error[ci][None, :]
        some = np.count_nonzero(near)
        least = np.maximum(best[asking, -1], (wanted6 << 32) - 1)
        if some * 8 > near.size:  # most have to be compared exactly: all at once
            key = (np.rint((q[asking] @ x[ci].T) * 1e6).astype(np.int64) << 32) + place[ci][None, :]
            qs, cs = np.nonzero(key > least[:, None])
            key = key[qs, cs]
        elif some:
            qs, cs = np.nonzero(near)
            key = (np.rint(np.einsum("nd,nd->n", q[asking[qs]], x[ci[cs]]) * 1e6).astype(np.int64) << 32) + place[ci[cs]]
            good = key > least[qs]
            qs, cs, key = qs[good], cs[good], key[good]
        else:
            return
        qs, cs = asking[qs], ci[cs]
        other = own[qs] != cs
        qs, cs, key = qs[other], cs[other], key[other]
        if not len(qs):
            return
        who = np.unique(qs)
        qs = np.concatenate([np.repeat(who, keep), qs])
        cs = np.concatenate([at[who].ravel(), cs])
        key = np.concatenate([best[who].ravel(), key])
        order = np.lexsort((-key, qs))
        turn = np.arange(len(qs)) - np.searchsorted(qs[order], qs[order])
        order = order[turn < keep]
        best[who], at[who] = key[order].reshape(-1, keep), cs[order].reshape(-1, keep)
        floor[who] = np.maximum(wanted6, best[who, -1] >> 32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, base = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([np.asarray(batch.column(i)) for i in range(2)], 1)
            cuts = [0, *(np.flatnonzero((np.diff(key, axis=0) != 0).any(1)) + 1).tolist(), len(key)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                part, (task, kind) = batch.slice(x, y - x), key[x]
                if task != here:
                    here, base = task, []
                if kind == 0:
                    base.append(part)
                elif base:
                    out = answer(base, part)
                    if out is not None:
                        yield out

    return run


def similar_directions(directions: DataFrame, dim: int, wanted: float, keep: int = 4) -> DataFrame:
    """(a, b, sim): for every ``rep`` a at least its first ``keep`` others b with a cosine of at least ``wanted``, none missed.

    ``directions``: rep (unique string), vec (unit vector). The index is fitted on about ``SAMPLE`` vectors (8 a cell from 4,096 cells on) chosen by
    hash and holds all of them. Every vector lies in its best cell, in a ring by its angle from the centre; near cells
    of a ring make a block. A vector asks every block that the angles do not exclude, and in it every ring that the
    angles and the best found so far do not exclude; there is no fixed number of probes. A group of vectors that are
    all similar to each other is thus compared pairwise. Similarities are exact cosines rounded to 6 decimals.
    """
    spark = directions.sparkSession
    path = scratch(spark, "directions")
    directions.select("rep", "vec").write.parquet(path)
    kept = spark.read.parquet(path)
    n = kept.count()
    if not n:
        return spark.createDataFrame([], "a string, b string, sim double")
    cells = anisotropic.coarse_cells(n)
    one_in = -(-n // max(SAMPLE, 8 * cells))
    sample = kept.where(F.pmod(F.xxhash64("rep", F.lit(42)), F.lit(one_in)) == 0).select("vec").toArrow()
    if not sample.num_rows:
        sample = kept.limit(SAMPLE).select("vec").toArrow()
    x = _matrix(sample.column(0).combine_chunks(), dim)
    x = x[np.lexsort(x.T[:3])]  # the same order in every run
    model = anisotropic.train(x, min(cells, len(x)))
    sent = spark.sparkContext.broadcast(model)

    def index(batches):
        return _index(sent.value)(batches)

    def search(batches):
        return _search(sent.value, wanted, keep)(batches)

    placed = scratch(spark, "cells")
    kept.mapInArrow(index, "rep string, vec array<double>, unit int, angle double, code binary, error double").write.parquet(placed)
    rows = spark.read.parquet(placed)
    found = rows.groupBy("unit").agg(F.count(F.lit(1)), F.min("angle"), F.max("angle")).orderBy("unit").collect()  # at most MAX_CELLS * RINGS rows
    unit, count, low, high = (np.array(c) for c in zip(*found, strict=True))
    first, pieces = _blocks(model.centres, unit, count, int(np.clip(n // LEAST_BLOCKS, 512, BLOCK)))

    def ask(batches):
        return _ask(sent.value, unit, low, high, first, pieces, wanted)(batches)

    asked_at = scratch(spark, "asks")
    rows.select("rep", "vec").mapInArrow(ask, "rep string, vec array<double>, asks array<int>").write.parquet(asked_at)
    asked = spark.read.parquet(asked_at).select("rep", "vec", F.explode("asks").alias("block"))
    per_block = asked.groupBy("block").count().orderBy("block").collect()  # one row a block
    tasks, parts = [], 0
    most = int(np.clip(n // LEAST_PARTS, 512, QUERIES))
    for r in per_block:
        cut = -(-r["count"] // most)
        tasks.append((r["block"], parts, cut))
        parts += cut
    plan = F.broadcast(spark.createDataFrame(tasks, "block int, _t int, _n int"))
    homes = F.broadcast(spark.createDataFrame([tuple(map(int, r)) for r in zip(unit, first, pieces, strict=True)], "unit int, _f int, _p int"))
    block = (F.col("_f") + F.pmod(F.xxhash64("rep", F.lit(7)), F.col("_p"))).cast("int")
    base = rows.join(homes, "unit").withColumn("block", block).join(plan, "block").select(
        F.explode(F.sequence(F.col("_t"), F.col("_t") + F.col("_n") - 1)).alias("task"), F.lit(0).alias("kind"), "rep", "vec", "unit", "angle", "code", "error"
    )
    task = (F.col("_t") + F.pmod(F.xxhash64("rep"), F.col("_n"))).cast("int")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("unit", "int"), ("angle", "double"), ("code", "binary"), ("error", "double"))]
    queries = asked.join(plan, "block").select(task.alias("task"), F.lit(1).alias("kind"), "rep", "vec", *none)
    laid = base.unionByName(queries).repartitionById(parts, F.col("task")).sortWithinPartitions("task", "kind")
    return laid.mapInArrow(search, "a string, b string, sim double")


def nearest_pairs(docs: DataFrame, *, k: int = 3, wanted: float = 0.8, dim: int = 64) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs with rounded cosine >= ``wanted`` where one is among the other's first k.

    First: by similarity descending, then id ascending by bytes, itself left out. Vectors of the same
    direction (copies, scaled copies) form one class with its k + 1 smallest ids; classes are searched, and
    each member gets its first k from the k + 1 first ids of its class's list. A group of copies thus costs one
    search and k pairs a member, however large it is. Fewer than two valid vectors: no rows.
    """
    spark = docs.sparkSession
    path = scratch(spark, "vectors")
    valid_vectors(docs, dim).write.parquet(path)
    all_rows = spark.read.parquet(path)
    ranked = all_rows.withColumn("_r", F.row_number().over(Window.partitionBy("cls").orderBy("id"))).where(F.col("_r") <= k + 1)
    where = scratch(spark, "classes")
    firsts = F.sort_array(F.collect_list("id"))  # at most k + 1
    ranked.groupBy("cls").agg(firsts.alias("firsts"), F.min_by("vec", "id").alias("vec")).withColumn("rep", F.col("firsts")[0]).write.parquet(where)
    classes = spark.read.parquet(where)
    pairs_at = scratch(spark, "pairs")
    similar_directions(classes, dim, wanted, k + 1).write.parquet(pairs_at)
    found = spark.read.schema("a string, b string, sim double").parquet(pairs_at)
    best = found.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy(F.col("sim").desc(), "b"))).where(F.col("_r") <= k + 1)
    names = classes.select("rep", "cls", "firsts")
    theirs = best.join(names.select(F.col("rep").alias("b"), "firsts"), "b").select("a", "sim", F.explode("firsts").alias("id"))
    own = names.select(F.col("rep").alias("a"), F.lit(1.0).alias("sim"), F.explode("firsts").alias("id"))
    merged = theirs.unionByName(own)
    merged = merged.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy(F.col("sim").desc(), "id"))).where(F.col("_r") <= k + 1)
    lists = merged.groupBy("a").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "id"))), lambda s: s["id"]).alias("near"))
    lists = lists.join(names.select(F.col("rep").alias("a"), "cls"), "a").select("cls", "near")
    mine = all_rows.select("id", "cls").join(lists, "cls")
    others = F.slice(F.filter("near", lambda y: y != F.col("id")), 1, k)
    out = mine.select("id", F.explode(others).alias("_y"))
    return out.select(F.least("id", "_y").alias("id_a"), F.greatest("id", "_y").alias("id_b")).distinct()


def exact_nearest(queries: DataFrame, base: DataFrame, *, k: int = 3, block: int = 2048) -> DataFrame:
    """(id, other, sim): exact first k of each query against all rows of ``base``, by blocks of queries.

    For audits of the index: ``queries`` are read by the driver block by block (a stated query set, not all rows).
    Both need id and a unit vec.
    """
    spark, parts, held = base.sparkSession, None, []

    def scan(ids: list[str], q: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            for b in batches:
                if not b.num_rows:
                    continue
                names = np.array(b.column(0).to_pylist(), object)
                sims = np.round(q @ _matrix(b.column(1), q.shape[1]).T, 6)
                for i, name in enumerate(ids):
                    order = np.lexsort((names, -sims[i]))
                    order = [o for o in order[: k + 1] if names[o] != name][:k]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(order)), pa.array(names[order].tolist(), pa.string()), pa.array(sims[i][order])], names=["id", "other", "sim"])

        return base.select("id", "vec").mapInArrow(run, "id string, other string, sim double")

    for r in queries.select("id", "vec").toLocalIterator():
        held.append(r)
        if len(held) == block:
            one = scan([h[0] for h in held], np.array([h[1] for h in held]))
            parts, held = one if parts is None else parts.unionByName(one), []
    if held or parts is None:
        one = scan([h[0] for h in held], np.array([h[1] for h in held]).reshape(len(held), -1))
        parts = one if parts is None else parts.unionByName(one)
    w = Window.partitionBy("id").orderBy(F.col("sim").desc(), "other")
    return parts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
