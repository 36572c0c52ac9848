"""Per-document text quality statistics and how far each document lies from the prose of its language."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronodoc.llm.textscan import LETTER, NUMBER, Terms, blocks, classes, codepoints, hash_terms, scan_terms
from chronodoc.session import scratch

#: fixed values: characters that end a line of prose
LINE_ENDS = ".!?;:。！？"
#: The statistics, in the order of the vectors below. Word count enters as ln(1 + words).
STATS = ["log_words", "word_length", "symbols", "line_ends", "common_words"]
#: Failing side of each check: (name, statistic, sign, threshold); sign -1 fails below, +1 fails above.
CHECKS = [
    ("few_words", "log_words", -1, float(np.log1p(40))),
    ("word_length", "word_length", -1, 3.5),
    ("word_length", "word_length", 1, 9.0),
    ("symbols", "symbols", 1, 0.15),
    ("line_ends", "line_ends", -1, 0.3),
    ("common_words", "common_words", -1, 0.15),
]
#: Documents of the whole collection whose weight is added to the figures of every language.
PRIOR = 50
#: Squared distance that keeps a document in the core of prose: the 97.5 % point of chi-square with 5 degrees.
CORE = 12.83
#: Most rounds of re-estimation on the core.
ROUNDS = 6


def scan_statistics(texts: list[str], common: np.ndarray) -> dict[str, np.ndarray]:
    """Exact counts per text: words, letters in words, inked characters, symbols, lines, ended lines, common words."""
    out = {k: np.zeros(len(texts), np.int64) for k in ("words", "word_chars", "ink", "symbols", "lines", "ended", "common")}
    for a, b in blocks(texts):
        part = texts[a:b]
        scan = scan_terms(part)
        _count(part, scan, common, {k: v[a:b] for k, v in out.items()})
    return out


def _count(texts: list[str], scan: Terms, common: np.ndarray, out: dict[str, np.ndarray]) -> None:
    def per_text(flags: np.ndarray, borders: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[borders])

    out["words"][:] = np.diff(scan.bounds)
    out["word_chars"][:] = per_text(scan.ends - scan.starts, scan.bounds)
    at = np.minimum(np.searchsorted(common, scan.hashes), max(0, len(common) - 1))
    out["common"][:] = per_text(common[at] == scan.hashes if len(common) else np.zeros(len(at), bool), scan.bounds)
    # lower-casing changes neither class nor number of characters, but for capital I with a dot
    if any("İ" in t for t in texts):
        cp = codepoints("\n".join(texts) + "\n")
        offsets = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
    else:
        cp, offsets = scan.cp, scan.offsets
    cls = classes()[cp]
    blank = (cp == 32) | (cp == 9) | (cp == 13) | (cp == 10)
    ink = np.flatnonzero(~blank)
    borders = np.searchsorted(ink, offsets)
    kind = cls[ink]
    out["ink"][:] = np.diff(borders)
    out["symbols"][:] = per_text((kind < LETTER) | (kind > NUMBER), borders)
    # the last inked character of a line is the one before a line feed (each text ends with one)
    feeds = np.flatnonzero(cp == 10)
    before = np.searchsorted(ink, feeds) - 1
    line_text = np.searchsorted(offsets, feeds, "right") - 1
    start = np.append(-1, feeds[:-1])
    real = before >= 0
    last = ink[np.maximum(before, 0)] if len(ink) else np.zeros(len(feeds), np.int64)
    real &= last > start
    good = real & np.isin(cp[last], [ord(c) for c in LINE_ENDS])
    out["lines"][:] = np.bincount(line_text[real], minlength=len(texts))
    out["ended"][:] = np.bincount(line_text[good], minlength=len(texts))


COUNTS = "doc_id long, lang string, words long, word_chars long, ink long, symbol_chars long, lines long, ended long, common long"


def language(col: Column) -> Column:
    """Primary language subtag in lower case; ``und`` for null, empty and unknown ones."""
    main = F.lower(F.regexp_extract(F.btrim(col), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    return F.when(F.coalesce(main, F.lit("")) == "", "und").otherwise(main)


def text_counts(docs: DataFrame, common_words: DataFrame, max_words: int = 1_000_000) -> DataFrame:
    """Exact counts per row with non-null text (``COUNTS``): one scan, no shuffle.

    The list of common words is read by the driver; it is a word list of bounded size (checked).
    """
    words = [r[0] for r in common_words.where(F.col("word").isNotNull()).select("word").distinct().limit(max_words + 1).collect()]
    if len(words) > max_words:
        raise ValueError(f"more than {max_words} common words")
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(hash_terms(words)) if words else np.zeros(0, np.uint64))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                c = scan_statistics(part.column(2).to_pylist(), sent.value)
                cols = [pa.array(c[k]) for k in ("words", "word_chars", "ink", "symbols", "lines", "ended", "common")]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=[f.split()[0] for f in COUNTS.split(", ")])

    rows = docs.where(F.col("text").isNotNull()).select("doc_id", language(F.col("lang")).alias("lang"), "text")
    return rows.mapInArrow(scan, COUNTS)


def with_statistics(counts: DataFrame) -> DataFrame:
    """Adds the statistics; they are null for texts without a word, except log_words."""
    has = F.col("words") > 0
    return counts.select(
        "*",
        F.log1p("words").alias("log_words"),
        F.when(has, F.col("word_chars") / F.col("words")).alias("word_length"),
        F.when(has, F.col("symbol_chars") / F.col("ink")).alias("symbols"),
        F.when(has, F.col("ended") / F.col("lines")).alias("line_ends"),
        F.when(has, F.col("common") / F.col("words")).alias("common_words"),
    )


MODEL = "lang string, n long, mu array<double>, precision array<double>, bound double"
D = len(STATS)
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]


def _consistency(p: int, q: float, share: float) -> float:
    """What the covariance of the core must be multiplied with: share / P(chi-square with p + 2 degrees <= q), p odd."""
    total, term = 0.0, math.sqrt(2 * q / math.pi) * math.exp(-q / 2)
    for k in range((p + 1) // 2):
        total += term
        term *= q / (2 * k + 3)
    return share / (math.erf(math.sqrt(q / 2)) - total)


def _shrunk(own: np.ndarray, n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Averages per language, drawn towards that of all documents as if ``PRIOR`` of those belonged to each language."""
    w = n.reshape(-1, *[1] * (own.ndim - 1))
    return (own * w + whole * PRIOR) / (w + PRIOR)


def _start(rows: DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
    """(languages, means, covariances): medians and squared, scaled median absolute deviations, on the diagonal.

    Where the median deviation is zero (half the documents have the same value) the mean deviation stands in.
    """
    def figures(df: DataFrame, values: list[Column], *more: Column) -> list:
        middle = [F.percentile_approx(v, 0.5, 10_000).alias(f"m{i}") for i, v in enumerate(values)]
        return df.rollup("lang").agg(F.grouping("lang").alias("g"), F.count(F.lit(1)).alias("n"), *middle, *more).collect()  # one row a language

    def split(found: list, name: str) -> tuple[dict, np.ndarray]:
        get = lambda r: np.array([r[f"{name}{i}"] for i in range(D)], float)
        return {r["lang"]: get(r) for r in found if not r["g"]}, next(get(r) for r in found if r["g"])

    first = figures(rows, [F.col(s) for s in STATS])
    n = {r["lang"]: r["n"] for r in first if not r["g"]}
    langs = sorted(n)
    if not langs:
        return [], np.zeros((0, D)), np.zeros((0, D, D))
    counts = np.array([n[x] for x in langs], float)
    medians, whole = split(first, "m")
    mu = _shrunk(np.array([medians[x] for x in langs]), counts, whole)
    middle = rows.sparkSession.createDataFrame([(x, m.tolist()) for x, m in zip(langs, mu, strict=True)], "_l string, _m array<double>")
    off = [F.abs(F.col(s) - F.col("_m")[i]) for i, s in enumerate(STATS)]
    both = rows.join(F.broadcast(middle), F.col("lang") == F.col("_l"))  # one row a language
    second = figures(both, off, *[F.avg(x).alias(f"a{i}") for i, x in enumerate(off)])
    (mad, all_mad), (mean, all_mean) = split(second, "m"), split(second, "a")
    scale = lambda m, a: np.where(m > 1e-9, 1.4826 * m, 1.2533 * a) ** 2 + 1e-6
    var = _shrunk(np.array([scale(mad[x], mean[x]) for x in langs]), counts, scale(all_mad, all_mean))
    return langs, mu, np.stack([np.diag(v) for v in var])


def _core(rows: DataFrame, langs: list, mu: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents of the core per language, means, covariances) within the 97.5 % distance of a model, shrunk."""
    near = scored(rows, _model(rows.sparkSession, langs, np.zeros(len(langs)), mu, cov)).where(F.col("distance") <= CORE)
    sums = [F.sum(F.col(s)).alias(f"s{i}") for i, s in enumerate(STATS)]
    products = [F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"q{i}_{j}") for i, j in PAIRS]
    found = {r["lang"]: r for r in near.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect()}  # one row a language
    n, s, q = np.zeros(len(langs)), np.zeros((len(langs), D)), np.zeros((len(langs), D, D))
    for k, x in enumerate(langs):
        if x in found:
            n[k], s[k] = found[x]["n"], [found[x][f"s{i}"] for i in range(D)]
            for i, j in PAIRS:
                q[k, i, j] = q[k, j, i] = found[x][f"q{i}_{j}"]
    if not n.sum():
        return n, mu, cov
    own = np.maximum(n, 1)
    centre = _shrunk(s / own[:, None], n, s.sum(0) / n.sum())
    second = _shrunk(q / own[:, None, None], n, q.sum(0) / n.sum())
    spread = (second - centre[:, :, None] * centre[:, None, :]) * _consistency(D, CORE, 0.975)
    diagonal = np.maximum(np.einsum("kii->ki", spread), 0) * 1e-6 + 1e-6  # stays invertible for constant statistics
    return n, centre, spread + diagonal[:, :, None] * np.eye(D)


def _model(spark: SparkSession, langs: list, n: np.ndarray, mu: np.ndarray, cov: np.ndarray) -> DataFrame:
    rows = [(x, int(k), m.tolist(), np.linalg.inv(c).ravel().tolist(), screening_bound(m, c)) for x, k, m, c in zip(langs, n, mu, cov, strict=True)]
    return spark.createDataFrame(rows, MODEL)


def screening_bound(mu: np.ndarray, cov: np.ndarray) -> float:
    """The least squared distance that any point failing any check can have.

    Over a half-space x_j <= t the least squared Mahalanobis distance from mu is (mu_j - t)^2 / cov_jj, and 0 if
    mu itself lies in it; so no document that fails a check lies nearer than the least of these.
    """
    least = np.inf
    for _, s, sign, t in CHECKS:
        j = STATS.index(s)
        gap = max(0.0, sign * (t - mu[j]))
        least = min(least, gap * gap / cov[j, j])
    return float(least * (1 - 1e-6))


def distance(mu: Column, precision: Column) -> tuple[Column, list[Column]]:
    """(squared Mahalanobis distance, each statistic's part of it); the parts add up to the distance."""
    dev = [F.col(s) - mu[i] for i, s in enumerate(STATS)]
    parts = []
    for i in range(D):
        row = sum((precision[i * D + j] * dev[j] for j in range(1, D)), precision[i * D] * dev[0])
        parts.append(dev[i] * row)
    return sum(parts[1:], parts[0]), parts


def prose_models(stats: DataFrame) -> DataFrame:
    """Robust mean and covariance per language (``MODEL``), from the core of its prose; no threshold of any check enters.

    The start is the medians and median absolute deviations of all documents with words; then the model is estimated anew
    from the documents within the 97.5 % distance of the last one, until the core has the same size or ``ROUNDS`` are
    over, so that lists, tables and junk lose their pull. A language's figures are drawn towards those of all documents
    with the weight of ``PRIOR`` documents, whatever its size. A round is one scan of the small statistics table and one
    map-side combined sum; the driver gets one row a language (codes of two or three letters, so at most some
    thousands).
    """
    rows = stats.where(F.col("words") > 0)
    langs, mu, cov = _start(rows)
    n = np.zeros(len(langs))
    for _ in range(ROUNDS if langs else 0):
        before = n
        n, mu, cov = _core(rows, langs, mu, cov)
        if np.array_equal(n, before):
            break
    return _model(stats.sparkSession, langs, n, mu, cov)


def scored(stats: DataFrame, models: DataFrame) -> DataFrame:
    """Statistics with the model's ``distance``, ``contributions`` and ``bound``; null where a text has no word."""
    own = F.broadcast(models.select(F.col("lang").alias("_l"), "mu", "precision", F.col("bound").alias("_b")))  # one row a language
    both = stats.join(own, F.col("lang") == F.col("_l"), "left")
    total, parts = distance(F.col("mu"), F.col("precision"))
    return both.select(*[stats[c] for c in stats.columns], total.alias("distance"), F.array(*parts).alias("contributions"), F.col("_b").alias("bound"))


def text_quality(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """Counts, statistics, distance and contributions of every row with non-null text.

    Null texts give no row; empty and wordless texts have words = 0, log_words = 0 and null otherwise.
    Plan: the texts are scanned once; the small counts table is written to the shared folder, and the models are
    estimated from it.
    """
    path = scratch(docs.sparkSession, "quality")
    text_counts(docs, common_words).write.parquet(path)
    stats = with_statistics(docs.sparkSession.read.schema(COUNTS).parquet(path))
    return scored(stats, prose_models(stats))


def failed_checks(quality: DataFrame) -> DataFrame:
    """(doc_id, failed_check): documents screened by distance, then held against the checks on exact counts.

    A document nearer to its language's prose than ``bound`` can fail no check (see ``screening_bound``), so
    screening loses nothing. Comparisons are on whole-number counts' quotients.
    """
    far = quality.where(F.col("distance").isNull() | F.col("bound").isNull() | (F.col("distance") >= F.col("bound")))
    w = F.col("words")
    failed = F.array(
        F.when(w < 40, "few_words"),
        F.when((w > 0) & ((F.col("word_length") < 3.5) | (F.col("word_length") > 9)), "word_length"),
        F.when((w > 0) & (F.col("symbols") > 0.15), "symbols"),
        F.when((w > 0) & (F.col("line_ends") < 0.3), "line_ends"),
        F.when((w > 0) & (F.col("common_words") < 0.15), "common_words"),
    )
    return far.select("doc_id", F.explode(F.array_compact(failed)).alias("failed_check"))
