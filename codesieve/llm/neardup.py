"""SimHash near duplicates: fingerprints, bit-sliced comparison inside buckets, connected components.

near_duplicates() finds every pair within RADIUS bits. first_of_each(), which thins a corpus, also has to catch copies with a tenth of their words
changed, whose fingerprints lie some 8 to 13 bits apart; its radius is WIDE, at which unrelated texts meet by chance, so that texts must share shingles
too. Buckets by samples of the shingles find most groups; then every pair of texts of different groups that shares a shingle by which pairs with SHARE
of their shingles in common must meet (prefix filter) is compared, and what lies within WIDE bits is held against the texts.

Documents with one fingerprint collapse to one row first. Two fingerprints within 2 bits agree in at least two of four 16-bit
blocks, so each fingerprint goes to six buckets of 32 fixed bits; a bucket above HOT is split the same way by its other 32
bits, after which at most 2^16 fingerprints share one. Inside a bucket a lane is compared with the lane d places on: the bit planes of
all lanes are long integers, distances are counted by carry-save counters over whole planes, and a block of lanes is
abandoned as soon as every distance exceeds the radius.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import again, column, raw, ship, slices, stash, unstash, whole

RADIUS = 2
HOT = 1024
LANES = 1 << 14
#: Of first_of_each: bits that near copies may differ in (unrelated texts differ in 32 or so); bucket keys of a text, and shingles that make a key.
WIDE = 18
KEYS, SAMPLE = 12, 3
#: Shingles in common, as a part of the union, that make texts within WIDE bits near copies whatever their keys.
SHARE = 0.5
#: Lanes of a bucket that are compared in one place; a larger one is cut into parts, and each two parts meet. Lanes from which a bucket is compared row by row.
PART, ROWWISE = 1 << 14, 128
#: Shingles (of a sample of the rows) among which frequent ones are sought, times that make one frequent, and the most of these. They only decide in what
#: order a text's shingles come.
ASKED, OFTEN, MOST_OFTEN = 5_000_000, 5, 1 << 17
#: Bytes of shingles that are sorted in one place.
SHARD_BYTES = 16 << 20
_ORDERS = np.random.default_rng(5).integers(1, 1 << 63, KEYS * SAMPLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PAIRS = list(combinations(range(4), 2))


def shingles(words: list[bytes], width: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of the shingles, repeats included; of the whole sequence if that is shorter, of nothing if it is empty."""
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    view, digest = memoryview(line), xxhash.xxh64_intdigest
    n = len(words)
    if n <= width:
        return np.array([digest(line, 42)], np.uint64)
    ends = np.flatnonzero(np.frombuffer(line, np.uint8) == 32).tolist() + [len(line)]
    starts = [0, *[e + 1 for e in ends[: n - width]]]
    return np.array([digest(view[a:b], 42) for a, b in zip(starts, ends[width - 1 :])], np.uint64)


def majority(h: np.ndarray) -> int:
    """Bit b is set if it is in over half the hashes; of none: 0."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(h), bitorder="little").tobytes(), "little")


def simhash(words: list[bytes], width: int = 3) -> int:
    return majority(shingles(words, width))


def sample_keys(h: np.ndarray) -> list[int]:
    """KEYS numbers, each made of the least SAMPLE hashes' worth under as many orders: texts that share a part j of their shingles share each key with chance j ** SAMPLE."""
    if not len(h):
        return []
    least = [(h * m).min() for m in _ORDERS]
    return [xxhash.xxh64_intdigest(np.array(least[k : k + SAMPLE]).tobytes()) - (1 << 63) for k in range(0, len(least), SAMPLE)]


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        fps = np.array([simhash(t.lower().split()) for t in raw(part.column("text"))], np.uint64)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for each row; bytes.lower changes A-Z alone and bytes.split splits at exactly the six characters."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprint, "doc_id long, fp long")


def near_lanes(fps: np.ndarray, sizes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Lane pairs (i, j) of one bucket whose fingerprints differ in at most radius bits. fps: buckets one after another, of these sizes, falling."""
    n, left, right = len(fps), [], []
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    planes = [int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little") for row in bits]
    starts = np.cumsum(sizes) - sizes
    ends = np.repeat(starts + sizes, sizes)
    width = max(1, radius.bit_length())
    for d in range(1, int(sizes[0])):
        last = int(np.searchsorted(-sizes, -d, side="left"))  # buckets with more than d lanes come first
        top = int(starts[last - 1] + sizes[last - 1])
        valid = np.arange(top) + d < ends[:top]
        cut = (1 << top) - 1
        alive = int.from_bytes(np.packbits(valid, bitorder="little").tobytes(), "little")
        counters = [0] * width
        for k, p in enumerate(planes):
            carry = (p ^ (p >> d)) & cut
            for j in range(width):
                counters[j], carry = counters[j] ^ carry, counters[j] & carry
            alive &= ~carry  # a counter that runs over is above any radius
            if k >= radius:  # no distance is above it before
                above, equal = 0, alive
                for j in range(width - 1, -1, -1):
                    if radius >> j & 1:
                        equal &= counters[j]
                    else:
                        above |= equal & counters[j]
                        equal &= ~counters[j]
                alive &= ~above
            if not alive:
                break
        if alive:
            hit = np.flatnonzero(np.unpackbits(np.frombuffer(alive.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")[:n])
            left.append(hit)
            right.append(hit + d)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _first_pair(x: np.ndarray, width: int) -> np.ndarray:
    """The first of the six block pairs in which two fingerprints agree, by their XOR restricted to 4 blocks of width bits."""
    mask = np.uint64((1 << width) - 1)
    same = [((x >> np.uint64(width * b)) & mask) == 0 for b in range(4)]
    first = np.full(len(x), 6, np.int64)
    for k in range(5, -1, -1):
        i, j = _PAIRS[k]
        first[same[i] & same[j]] = k
    return first


def _rest(fps: np.ndarray, table: int) -> np.ndarray:
    """The 32 bits outside the two blocks of a table."""
    i, j = (b for b in range(4) if b not in _PAIRS[table])
    m = np.uint64(0xFFFF)
    return ((fps >> np.uint64(16 * i)) & m) | (((fps >> np.uint64(16 * j)) & m) << np.uint64(16))


_LINK = pa.schema([("fp", pa.int64()), ("near", pa.int64()), ("root", pa.int64())])


def _joined(n: int, a: np.ndarray, b: np.ndarray, order: np.ndarray) -> list[int]:
    """The first lane, by order, of each lane's component."""
    root = list(range(n))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i, j in zip(a.tolist(), b.tolist()):
        i, j = find(i), find(j)
        if i != j:
            if order[i] > order[j]:
                i, j = j, i
            root[j] = i
    return [find(k) for k in range(n)]


def _falling(cut: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lanes by bucket, large buckets first, and the sizes, of n lanes whose buckets begin at cut."""
    sizes = np.diff(np.r_[cut, n])
    order = np.argsort(-sizes, kind="stable")
    return np.concatenate([np.arange(cut[k], cut[k] + sizes[k]) for k in order]), sizes[order]


def _compare(tab: np.ndarray, sub: np.ndarray, key: np.ndarray, fps: np.ndarray, n: np.ndarray) -> pa.RecordBatch | None:
    """Links of whole buckets: for each fingerprint the documents it links to, and the smallest fingerprint its bucket joins it to."""
    lanes, sizes = _falling(_borders(tab, sub, key), len(fps))
    tab, sub, fps, n = tab[lanes], sub[lanes], fps[lanes], n[lanes]
    a, b = near_lanes(fps, sizes)
    x = fps[a] ^ fps[b]
    good = _first_pair(x, 16) == tab[a]  # each pair counts in one bucket alone
    for k in np.unique(tab[a]):
        mine = (tab[a] == k) & (sub[a] >= 0)
        good[mine] &= _first_pair(_rest(x[mine], int(k)), 8) == sub[a][mine]
    a, b = a[good], b[good]
    if not len(a):
        return None
    near = np.zeros(len(fps), np.int64)
    np.add.at(near, a, n[b])
    np.add.at(near, b, n[a])
    signed = fps.view(np.int64)
    root = _joined(len(fps), a, b, signed)
    used = np.unique(np.r_[a, b])
    return pa.RecordBatch.from_arrays([pa.array(signed[used]), pa.array(near[used]), pa.array(signed[[root[k] for k in used]])], schema=_LINK)


_LED = pa.schema([("fp", pa.int64()), ("root", pa.int64()), ("tab", pa.int32()), ("key", pa.int64())])
_LED_DDL = "fp long, root long, tab int, key long"


def _lead(tab: np.ndarray, sub: np.ndarray, key: np.ndarray, fps: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Of whole buckets: each lane that another one leads, with that one, and of hot buckets (n above 0) the others with themselves."""
    lanes, sizes = _falling(_borders(tab, sub, key), len(fps))
    tab, key, fps, n = tab[lanes], key[lanes], fps[lanes], n[lanes]
    signed = fps.view(np.int64)
    root = np.array(_joined(len(fps), *near_lanes(fps, sizes, WIDE), signed), np.int64)
    used = np.flatnonzero((root != np.arange(len(fps))) | (n > 0))
    return pa.RecordBatch.from_arrays([pa.array(signed[used]), pa.array(signed[root[used]]), pa.array(tab[used], pa.int32()), pa.array(key[used])], schema=_LED)


def _borders(tab: np.ndarray, sub: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where buckets begin."""
    return np.flatnonzero(np.r_[True, (tab[1:] != tab[:-1]) | (sub[1:] != sub[:-1]) | (key[1:] != key[:-1])])


def _blocks(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Over rows sorted by bucket, which the first three columns name: buckets are gathered to blocks of about LANES lanes, whole ones only."""
    held: list[np.ndarray] = []
    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        held = [np.concatenate(x) for x in zip(held, new)] if held else new
        if len(held[0]) < LANES:
            continue
        stop = int(_borders(*held[:3])[-1])
        if stop:
            yield [x[:stop] for x in held]
            held = [x[stop:] for x in held]
    if held and len(held[0]):
        yield held


def _links(batches: Iterator[pa.RecordBatch], compare=_compare) -> Iterator[pa.RecordBatch]:
    for tab, sub, key, fps, n in _blocks(batches, ("tab", "sub", "key", "fp", "n")):
        if (r := compare(tab, sub, key, np.ascontiguousarray(fps).view(np.uint64), n)) is not None:
            yield r


def _block_key(value: str, pair: tuple[int, int], width: int) -> str:
    m = (1 << width) - 1
    return f"(shiftrightunsigned({value}, {width * pair[0]}) & {m}L) | shiftleft(shiftrightunsigned({value}, {width * pair[1]}) & {m}L, {width})"


def links(groups: DataFrame) -> DataFrame:
    """(fp, near, root) from (fp, n): parts of the number of linked documents, and edges to a smaller fingerprint."""
    keyed = groups.select("fp", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("tab"), F.expr(_block_key("fp", p, 16)).alias("key")) for k, p in enumerate(_PAIRS)])).alias("b")).select("fp", "n", "b.tab", "b.key")
    count = keyed.groupBy("tab", "key").agg(F.count("*").alias("m")).where("m > 1")
    keyed = keyed.join(count, ["tab", "key"])
    rests = []
    for p in _PAIRS:
        i, j = (b for b in range(4) if b not in p)
        rests.append(f"(shiftrightunsigned(fp, {16 * i}) & 65535L) | shiftleft(shiftrightunsigned(fp, {16 * j}) & 65535L, 16)")
    rest = F.element_at(F.array(*map(F.expr, rests)), F.col("tab") + 1)
    fine = F.array(*[F.struct(F.lit(k).alias("sub"), (F.shiftleft(F.col("key"), 16).bitwiseOR(F.expr(_block_key("rest", p, 8)))).alias("key")) for k, p in enumerate(_PAIRS)])
    whole = F.array(F.struct(F.lit(-1).alias("sub"), F.col("key")))
    lanes = keyed.withColumn("rest", rest).withColumn("b", F.explode(F.when(F.col("m") > HOT, fine).otherwise(whole))).select("tab", "b.sub", "b.key", "fp", "n")
    lanes = lanes.repartition("tab", "sub", "key").sortWithinPartitions("tab", "sub", "key", "fp")
    return lanes.mapInArrow(_links, "fp long, near long, root long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) from (u, v): the smallest node of each component, by alternating large and small stars; each round is a written table."""
    edges = stash(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, last = stash(large.where("u <> v").distinct(), "cc-large"), edges
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = stash(small.where("u <> v").distinct(), "cc-small")
        unstash(last, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
        before = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, n_near, component_id) for each row of docs.

    A null or empty text has fingerprint 0 and links like any other. Repeated rows are documents of their own that link to each other.
    Null ids count as documents but can't name a component unless all its ids are null. Other columns aren't read. An empty table gives none.
    """
    fps = stash(fingerprints(docs, id_col, text_col), "simhash")
    groups = stash(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")), "simhash-groups")
    found = stash(links(groups), "simhash-links")
    near = found.groupBy("fp").agg(F.sum("near").alias("near"))
    roots = components(found.select(F.col("fp").alias("u"), F.col("root").alias("v")))
    reps = groups.join(near, "fp", "left").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    reps = stash(reps, "simhash-reps")
    unstash(groups, found)
    firsts = reps.groupBy("root").agg(F.min("first").alias("component_id"))
    reps = reps.join(firsts, "root").select("fp", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_near"), "component_id")
    return fps.join(reps, "fp").select("doc_id", "fp", "n_near", "component_id")


@F.arrow_udf(T.StructType([T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("text", T.LongType()), T.StructField("size", T.IntegerType())]))
def _print_and_keys(texts: pa.Array) -> pa.Array:
    """Fingerprint, bucket keys, and a hash and the number of the different shingles."""
    each = [shingles(t.lower().split()) for t in raw(texts)]
    fps = np.array([majority(h) for h in each], np.uint64).view(np.int64)
    sets = [np.unique(h) for h in each]
    digests = np.array([xxhash.xxh64_intdigest(u.tobytes()) for u in sets], np.uint64).view(np.int64)
    parts = [pa.array(fps), pa.array([sample_keys(h) for h in each], pa.list_(pa.int64())), pa.array(digests), pa.array([len(u) for u in sets], pa.int32())]
    return pa.StructArray.from_arrays(parts, names=["fp", "keys", "text", "size"])


def _key_lanes(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tab, key, fp) for each bucket key, and (tab, key, n) of the buckets above HOT."""
    lanes = texts.select("fp", F.posexplode("keys").alias("tab", "key"))
    return lanes, stash(lanes.groupBy("tab", "key").agg(F.count("*").alias("n")).where(F.col("n") > HOT), "simhash-hot")


def wide_links(lanes: DataFrame, hot: DataFrame) -> DataFrame:
    """(fp, root): edges to a smaller fingerprint within WIDE bits that shares a key, all that matter but some of hot buckets (apart_in_hot finds those).

    A bucket above HOT is cut into parts by a hash of the fingerprint; what leads each part meets again in a second round, so only leaders, one
    for a cluster of copies and part, share a task.
    """
    lanes = lanes.join(hot, ["tab", "key"], "left").select("tab", F.coalesce(F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / HOT)), F.lit(0)).alias("sub"), "key", "fp", F.coalesce("n", F.lit(0)).alias("n"))
    lanes = lanes.repartition("tab", "sub", "key").sortWithinPartitions("tab", "sub", "key", "fp")
    once = stash(lanes.mapInArrow(lambda b: _links(b, _lead), _LED_DDL), "simhash-led")
    leaders = once.where("fp = root").select("tab", F.lit(0).alias("sub"), "key", "fp", F.lit(0).cast("long").alias("n")).repartition("tab", "key").sortWithinPartitions("tab", "key", "fp")
    again = leaders.mapInArrow(lambda b: _links(b, _lead), _LED_DDL)
    return once.where("fp <> root").select("fp", "root").unionByName(again.select("fp", "root"))


def _apart(cut: np.ndarray, fps: np.ndarray, root: np.ndarray, size: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Lanes (a, b) of one bucket, of different roots, within WIDE bits, whose sizes allow this share in common. cut: where buckets begin."""
    ends = np.r_[cut[1:], len(fps)]
    mixed = np.minimum.reduceat(root, cut) != np.maximum.reduceat(root, cut)
    small, left, right = mixed & (ends - cut < ROWWISE), [], []
    if small.any():
        lanes = np.concatenate([np.arange(x, y) for x, y in zip(cut[small], ends[small])])
        sizes = (ends - cut)[small]
        order, sizes = _falling(np.cumsum(sizes) - sizes, len(lanes))
        lanes = lanes[order]
        a, b = near_lanes(fps[lanes], sizes, WIDE)
        left, right = [lanes[a]], [lanes[b]]
    for x, y in zip(cut[mixed & ~small].tolist(), ends[mixed & ~small].tolist()):
        names, which = np.unique(root[x:y], return_inverse=True)
        for i in np.flatnonzero(which != np.bincount(which).argmax()).tolist():  # two lanes of the largest group need no comparison
            b = x + np.flatnonzero((np.bitwise_count(fps[x:y] ^ fps[x + i]) <= WIDE) & (which != which[i]))
            left.append(np.full(len(b), x + i))
            right.append(b)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    good = (root[a] != root[b]) & (np.minimum(size[a], size[b]) >= share * np.maximum(size[a], size[b]))
    return a[good], b[good]


def _parted(lanes: DataFrame, name: str) -> DataFrame:
    """Adds sub to lanes of buckets of n: each two parts of a bucket above PART share one, so its lanes are there as often as it has parts."""
    parts = F.ceil(F.col("n") / PART)
    part = F.pmod(F.xxhash64(name), parts)
    meet = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda j: F.least(part, j) * parts + F.greatest(part, j))
    return lanes.withColumn("sub", F.explode(F.when(F.col("n") > PART, meet).otherwise(F.array(F.lit(0).cast("long")))))


def _apart_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for tab, sub, key, fps, root in _blocks(batches, ("tab", "sub", "key", "fp", "root")):
        a, b = _apart(_borders(tab, sub, key), np.ascontiguousarray(fps).view(np.uint64), root, np.ones(len(fps)), 0)
        if len(a):
            pairs = np.unique(np.stack([np.maximum(root[a], root[b]), np.minimum(root[a], root[b])]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])


def apart_in_hot(lanes: DataFrame, hot: DataFrame, roots: DataFrame) -> DataFrame:
    """(u, v): roots of lanes of one hot bucket within WIDE bits that different roots have so far."""
    lanes = lanes.join(hot, ["tab", "key"]).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lanes = _parted(lanes, "fp").repartition("tab", "sub", "key").sortWithinPartitions("tab", "sub", "key")
    return lanes.select("tab", "sub", "key", "fp", "root").mapInArrow(_apart_roots, "u long, v long")


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        sets = [np.unique(shingles(t.lower().split())) for t in raw(part.column("text"))]
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(sets).tobytes()], pa.binary())], names=["data"])


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    data = [np.frombuffer(x, np.uint64) for batch in batches for x in batch.column("data").to_pylist()]
    if data:
        h, n = np.unique(np.concatenate(data), return_counts=True)
        order = np.argsort(-n, kind="stable")[: min(MOST_OFTEN, int((n >= OFTEN).sum()))]
        yield pa.RecordBatch.from_arrays([pa.array([h[order[::-1]].tobytes()], pa.binary())], names=["data"])


def frequent(rows: DataFrame, total: int) -> np.ndarray:
    """Shingles that are frequent in some of the rows, which have total shingles; the most frequent last."""
    some = rows.sample(False, min(1.0, ASKED / max(1, total)), 7).select("text").mapInArrow(_asked, "data binary")
    got = some.repartition(1).mapInArrow(_often, "data binary").collect()
    return np.frombuffer(bytes(got[0]["data"]), np.uint64) if got else np.zeros(0, np.uint64)


def prefix(h: np.ndarray, hot: np.ndarray, place: np.ndarray) -> np.ndarray:
    """So many of the different shingles h, first by one order for all texts, that two texts with SHARE in common have one of theirs in common.

    The order: the shingles that aren't hot by their hashes, then the hot ones by place. hot: sorted.
    """
    most = len(h) - math.ceil(SHARE * len(h)) + 1 if len(h) else 0
    if len(hot):
        at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
        h = h[np.lexsort((h, np.where(hot[at] == h, place[at] + 1, 0)))]
    return h[:most]


def _post(batches: Iterator[pa.RecordBatch], often: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """(shard, base, token, place): for each shard the upper halves of shingles, and the rows that have them, as uid - base."""
    place = np.argsort(often, kind="stable")
    hot = often[place]
    for part in slices(batches):
        sets = [prefix(np.unique(shingles(t.lower().split())), hot, place) for t in raw(part.column("text"))]
        h = np.concatenate(sets)
        uid = np.repeat(part.column("uid").to_numpy(), [len(x) for x in sets])
        base = uid >> 33 << 33
        shard = (h % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((shard, base))
        h, uid, base, shard = h[order], uid[order], base[order], shard[order]
        if not len(h):
            continue
        cut = np.flatnonzero(np.r_[True, (base[1:] != base[:-1]) | (shard[1:] != shard[:-1])])
        token, off = (h >> np.uint64(32)).astype(np.uint32), (uid - base).astype(np.uint32)
        each = list(zip(cut.tolist(), [*cut[1:].tolist(), len(h)]))
        yield pa.RecordBatch.from_arrays([pa.array(shard[cut], pa.int32()), pa.array(base[cut]), pa.array([token[x:y].tobytes() for x, y in each], pa.binary()), pa.array([off[x:y].tobytes() for x, y in each], pa.binary())], names=["shard", "base", "token", "place"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows of _post sorted by shard: (key, uid, n) for shingles that n rows have, n above 1."""

    def found(shard: int, tokens: list[np.ndarray], uids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, uid = np.concatenate(tokens), np.concatenate(uids)
        order = np.argsort(token, kind="stable")
        token, uid = token[order], uid[order]
        cut = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        n = np.diff(np.r_[cut, len(token)])
        n = np.repeat(n, n)
        many = n > 1
        key = token[many].astype(np.int64) | shard << 32
        for k in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16)]) for x in (key, uid[many], n[many])], names=["key", "uid", "n"])

    now, tokens, uids = None, [], []
    for batch in batches:
        for shard, base, token, off in zip(*(batch.column(c).to_pylist() for c in ("shard", "base", "token", "place"))):
            if shard != now and tokens:
                yield from found(now, tokens, uids)
                tokens, uids = [], []
            now = shard
            tokens.append(np.frombuffer(token, np.uint32))
            uids.append(np.frombuffer(off, np.uint32).astype(np.int64) + base)
    if tokens:
        yield from found(now, tokens, uids)


def _apart_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for n, sub, key, fps, root, uid, size in _blocks(batches, ("n", "sub", "key", "fp", "root", "uid", "size")):
        a, b = _apart(_borders(n, sub, key), np.ascontiguousarray(fps).view(np.uint64), root, size, SHARE)
        if len(a):
            a, b = np.where(uid[a] < uid[b], a, b), np.where(uid[a] < uid[b], b, a)
            _, first = np.unique(np.stack([uid[a], uid[b]]), axis=1, return_index=True)
            a, b = a[first], b[first]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (uid[a], uid[b], root[a], root[b])], names=["a", "b", "u", "v"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over pairs with their texts: those that have SHARE of their different shingles in common."""
    for batch in batches:
        sets: dict[int, np.ndarray] = {}
        good = []
        for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), raw(batch.column("x")), raw(batch.column("y"))):
            for k, t in ((a, x), (b, y)):
                if k not in sets:
                    sets[k] = np.unique(shingles(t.lower().split()))
            p, q = sets[a], sets[b]
            both = len(np.intersect1d(p, q, assume_unique=True))
            good.append(both >= SHARE * (len(p) + len(q) - both))
        yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))


def apart_but_alike(rows: DataFrame, texts: DataFrame, roots: DataFrame) -> DataFrame:
    """(u, v): roots of texts within WIDE bits that have SHARE of their shingles in common and that different roots have so far.

    rows: (uid, text, size). texts: (uid, fp, size), one row for each set of shingles. Frequent shingles come last in the order of the prefix filter, so
    few texts are asked for by them.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    rows = rows.select("uid", "text")
    often = rows.sparkSession.sparkContext.broadcast(frequent(rows, total))
    shards = max(4, math.ceil((1 - SHARE) * 8 * total / SHARD_BYTES))
    posted = rows.mapInArrow(lambda b: _post(b, often.value, shards), "shard int, base long, token binary, place binary")
    shared = posted.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_shared, "key long, uid long, n long")
    lanes = shared.join(texts.join(roots, "fp", "left").select("uid", "fp", "size", F.coalesce("root", "fp").alias("root")), "uid")
    lanes = _parted(lanes, "uid").repartition("key", "sub").sortWithinPartitions("key", "sub").select("n", "sub", "key", "fp", "root", "uid", "size")
    pairs = stash(lanes.mapInArrow(_apart_texts, "a long, b long, u long, v long").distinct(), "simhash-apart")
    some = pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct()
    asked = stash(rows.join(some, "uid", "left_semi"), "simhash-asked")
    both = pairs.join(asked.select(F.col("uid").alias("a"), F.col("text").alias("x")), "a").join(again(asked).select(F.col("uid").alias("b"), F.col("text").alias("y")), "b")
    found = stash(both.select("a", "b", "u", "v", "x", "y").mapInArrow(_alike, "u long, v long").distinct(), "simhash-alike")
    unstash(pairs, asked)
    return found


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of near copies, linked one by one.

    Linked are texts of one fingerprint, within RADIUS bits, or within WIDE bits if they share a sample of shingles (one of KEYS) or have SHARE of
    their different shingles in common (of the union). All such links count, of each text and in buckets of any size.

    It is the one with the smallest id, null last, then the least hash of all columns, so that reruns agree. Ids are otherwise not asked: groups
    with null ids, or with an id that rows of another group bear too, keep a row each. Null and empty texts are one group. docs may have any
    other columns, whatever their names (maps don't take part in the order). An empty table gives none. Texts are written once with a number
    for each row, read once more for their shingles, and shuffled once, by that number, but for those that only SHARE could link.
    """
    ship(docs.sparkSession)
    order = F.xxhash64(*[column(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()])
    rows = docs.select(whole(docs), F.col(id_col).cast("long").alias("doc_id"), order.alias("h"), F.monotonically_increasing_id().alias("uid"), _print_and_keys(F.col(text_col)).alias("p"))
    rows = stash(rows.select("row", "doc_id", "h", "uid", "p.*"), "simhash-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "uid")).alias("first")
    prints = stash(rows.groupBy("fp").agg(first), "simhash-prints")
    texts = stash(rows.groupBy("fp", F.col("text").alias("digest")).agg(F.min("uid").alias("uid"), F.min_by("keys", "uid").alias("keys"), F.min("size").alias("size")).drop("digest"), "simhash-texts")
    lanes, hot = _key_lanes(texts)
    near = links(prints.select("fp", F.lit(1).cast("long").alias("n"))).select("fp", "root")
    roots = stash(components(wide_links(lanes, hot).unionByName(near).select(F.col("fp").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "fp"), "simhash-roots")
    rest = apart_but_alike(rows.select("uid", F.col("row").getField(text_col).alias("text"), "size"), texts.select("uid", "fp", "size"), roots)
    if not hot.isEmpty():
        rest = rest.unionByName(apart_in_hot(lanes, hot, roots))
    grouped = prints.select("fp", "first").join(roots, "fp", "left").select("first", F.coalesce("root", "fp").alias("part"))
    merged = components(rest).withColumnRenamed("node", "part")
    grouped = grouped.join(merged, "part", "left").groupBy(F.coalesce("root", "part").alias("root"))
    stay = stash(grouped.agg(F.min("first").alias("first")).select("first.uid"), "simhash-stay")
    return rows.select("row", "uid").join(stay, "uid", "left_semi").select("row.*")
