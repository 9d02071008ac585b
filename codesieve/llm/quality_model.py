"""Quality classifier by hierarchical empirical Bayes.

Evidence of a document: the log odds of the distinctive features it shows (words, runs of signs, shares of capitals, signs and repeats), learned
from labelled documents with every odds shrunk toward the global one. Site rates: the expected rejects of all documents by host and by path
within the host, each level shrunk toward the one above it. Posterior log odds: evidence plus those of the document's path. How strongly hosts and
paths are shrunk is estimated from how far they lie apart beyond chance (method of moments).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import raw, ship, slices, stash, whole

#: Labelled documents that the features are learned from, at most: those with the smallest hashes of their ids.
MAX_LABELLED = 20_000
#: A feature counts if it raises the log odds by so much even when its counts are this many deviations worse than they look.
MIN_GAIN, DOUBT = 1.5, 1.0
#: Strength of the global odds in a feature's, in documents; least and greatest of a level of sites in the one below it.
SHRINK, WEAK, STRONG = 1.0, 1.0, 1e6
REJECT = 0.8
#: Stands for showing no distinctive feature, which is evidence as well.
NONE = b"\x00none"
_TOKENS = re.compile(rb"[0-9a-z\x80-\xff]+|[^\x00-\x20,.0-9A-Za-z\x80-\xff]+").findall
_LETTERS, _CAPITALS = re.compile(rb"[A-Za-z]").findall, re.compile(rb"[A-Z]").findall


def strength(mean: float, between: float) -> float:
    """Documents that a beta prior of this mean weighs, if its members' true rates have this variance; few digits, so that the order of sums doesn't show."""
    return round(min(max(mean * (1 - mean) / max(between, 1e-12) - 1, WEAK), STRONG), 2)


def features(text: bytes) -> set[bytes]:
    low = text.lower()
    tokens = _TOKENS(low)
    found = set(tokens)
    words = low.split()
    n = len(words)
    signs = sum(1 for t in tokens if t[0] < 48 or 57 < t[0] < 97 or 122 < t[0] < 128)
    capitals = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    found.add(b"\x00capitals %d" % (10 * capitals // max(1, len(text) - text.count(b" "))))
    found.add(b"\x00signs %d" % (10 * signs // max(1, n)))
    if n >= 20:
        pairs = set(zip(words, words[1:]))
        found.add(b"\x00repeats %d" % (10 - 10 * len(pairs) // (n - 1)))
    return found


def _sketch(found: set[bytes]) -> int:
    """Three minhashes of the features in one number: near copies mostly share it, other texts hardly ever do."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    least = [int((h * np.uint64(m)).min()) for m in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)] if len(h) else []
    return xxhash.xxh64_intdigest(repr(least).encode()) >> 1


def _shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        each = [features(t) for t in raw(part.column("text"))]
        yield pa.RecordBatch.from_arrays([pa.array(map(_sketch, each), pa.int64()), part.column("bad"), pa.array([sorted(f) for f in each], pa.list_(pa.binary()))], names=["key", "bad", "features"])


def _plain(known: frozenset[bytes], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bad of the rows that show none of the known features."""
    for b in batches:
        shows = [any(bytes(f) in known for f in row) for row in b.column("features").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("bad").filter(pa.array([not s for s in shows], pa.bool_()))], names=["bad"])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bad: str = "quality = 0 OR toxic = 1", max_labelled: int = MAX_LABELLED) -> tuple[dict[bytes, float], float]:
    """(log odds by feature and of NONE, global rate of rejects). Labels with a null id or verdict don't count; of several for an id each counts."""
    ship(docs.sparkSession)
    chosen = labels.select(F.col(id_col).cast("long").alias("__id"), F.expr(f"CAST({bad} AS int)").alias("bad")).where("__id IS NOT NULL AND bad IS NOT NULL")
    chosen = stash(chosen.orderBy(F.xxhash64("__id"), "__id", "bad").limit(max_labelled), "labelled")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("text", "bad")  # at most max_labelled pairs of numbers
    one = rows.mapInArrow(_shown, "key long, bad int, features array<binary>").groupBy("key").agg(F.max(F.struct("bad", "features")).alias("x"))
    one = stash(one.select("x.*"), "labelled-features")  # near copies would make their chance words look distinctive
    seen = one.select(F.explode("features").alias("feature"), "bad").groupBy("feature").agg(F.sum(1 - F.col("bad")).alias("good"), F.sum("bad").alias("bad"))
    total = one.agg(F.count("*").alias("n"), F.sum("bad").alias("bad")).first()
    n, k = total["n"] or 0, total["bad"] or 0
    p = (k + 1) / (n + 2)
    few = F.greatest(F.col("bad") - DOUBT * F.sqrt("bad"), F.lit(0.0))
    many = F.col("good") + DOUBT * F.sqrt(F.col("good") + 1)
    gain = F.log((few + SHRINK * p) / (many + SHRINK * (1 - p))) - math.log(p / (1 - p))
    kept = seen.where(gain > MIN_GAIN).select("feature", gain.alias("gain"))
    gains = {bytes(r["feature"]): r["gain"] for r in kept.collect()}  # features of a bounded sample
    plain = one.mapInArrow(lambda b: _plain(frozenset(gains), b), "bad int").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")).first()
    few, many = (plain["bad"] or 0) + SHRINK * p, plain["n"] - (plain["bad"] or 0) + SHRINK * (1 - p)
    return gains | {NONE: math.log(few / many) - math.log(p / (1 - p))}, p


def _scorer(spark: SparkSession, gains: dict[bytes, float]):
    """Evidence of a text column; the other columns don't leave the JVM."""
    model = spark.sparkContext.broadcast(gains)

    @F.arrow_udf(T.DoubleType())
    def evidence(texts: pa.Array) -> pa.Array:
        gain = model.value
        known = frozenset(gain)
        return pa.array([sum(sorted(gain[f] for f in features(t) & known or (NONE,))) for t in raw(texts)], pa.float64())

    return evidence


def _beyond_chance(sites: DataFrame, above: Column | float) -> float:
    """Variance of the sites' rates around that above, without what the documents within them spread: sites have n, k and q, sums of 1, x and x * x."""
    mean = F.col("k") / F.col("n")
    m = sites.agg(F.avg((mean - above) ** 2).alias("v"), F.avg(1 / F.col("n")).alias("one"), F.sum(F.col("q") - F.col("k") * mean).alias("within"), F.sum(F.col("n") - 1).alias("free")).first()
    return (m["v"] or 0.0) - (m["within"] or 0.0) / max(1, m["free"] or 0) * (m["one"] or 0.0)


def _sites(scored: DataFrame, p: float) -> DataFrame:
    """(h, p, host_rate, path_rate) from (host, path, evidence): hosts shrunk toward all documents, paths toward their host."""
    alone = 1 / (1 + F.exp(-(F.col("evidence") + math.log(p / (1 - p)))))
    millionths = lambda x: F.sum(F.round(x * 1e6).cast("long")) / 1e6  # noqa: E731  # whole, so that the sums don't depend on the order of rows
    paths = stash(scored.groupBy("host", "path").agg(F.count("*").alias("n"), millionths(alone).alias("k"), millionths(alone * alone).alias("q")), "paths")
    hosts = stash(paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "k", "q")]), "hosts")
    every = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    base = round(((every["k"] or 0) + p) / ((every["n"] or 0) + 1), 9)
    by_host = strength(base, _beyond_chance(hosts, base))
    hosts = stash(hosts.select(F.col("host").alias("h"), (F.col("k") / F.col("n")).alias("mean"), ((F.col("k") + by_host * base) / (F.col("n") + by_host)).alias("host_rate")), "host-rates")
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("h")))
    by_path = strength(base, _beyond_chance(paths, F.col("mean")))
    sites = paths.select("h", F.col("path").alias("p"), "host_rate", ((F.col("k") + by_path * F.col("host_rate")) / (F.col("n") + by_path)).alias("path_rate"))
    return stash(sites, "sites")  # of known size: broadcast only under Spark's threshold


def _posterior(evidence: Column) -> Column:
    return 1 / (1 + F.exp(-(evidence + F.log(F.col("path_rate") / (1 - F.col("path_rate"))))))


def _judged(scored: DataFrame, p: float, reject: float) -> DataFrame:
    """scored, with host_rate, path_rate, p_reject and kept."""
    sites = _sites(scored.select("host", "path", "evidence"), p)
    judged = scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p"))).withColumn("p_reject", _posterior(F.col("evidence")))
    return judged.withColumn("kept", F.col("p_reject") <= reject)


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", reject: float = REJECT, **training) -> DataFrame:
    """(doc_id, host, path, evidence, host_rate, path_rate, p_reject, kept) for each row of docs.

    The sites' rates come from all documents. A null or empty text shows none of the distinctive features; null hosts and paths are sites of their own; repeated
    rows are judged alike. Without labels the global rate is one half and nothing is distinctive. Other columns aren't read. An empty table gives none.
    """
    gains, p = train(docs, labels, id_col=id_col, text_col=text_col, **training)
    score = _scorer(docs.sparkSession, gains)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), score(F.col(text_col)).alias("evidence"))
    return _judged(stash(rows, "evidence"), p, reject).select("doc_id", "host", "path", "evidence", "host_rate", "path_rate", "p_reject", "kept")


def accepted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", reject: float = REJECT, **training) -> DataFrame:
    """The rows of docs that classify() keeps, which see; docs may have any other columns, whatever their names.

    Texts are scored once, written with their evidence, and never shuffled while the sites' table is small enough to be broadcast.
    """
    gains, p = train(docs, labels, id_col=id_col, text_col=text_col, **training)
    score = _scorer(docs.sparkSession, gains)
    rows = docs.select(whole(docs), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), score(F.col(text_col)).alias("evidence"))
    return _judged(stash(rows, "scored"), p, reject).where("kept").select("row.*")
