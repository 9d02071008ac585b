"""Substring dedup by fixed-block anchors.

Every 25th word of a document starts a reference block of 25 words; a window of 50 words holds at least one whole block. All
blocks make an index that is split by hash, and every rolling window of 25 words probes it. A probe learns the smallest document that has the
block. Of every 25 places a document takes the hit with the smallest such document, gets the words around that document's block, and extends the
hit word by word to the left and to the right: what both share over 50 words or more is a repeat, and hits in a row join to the maximal one. A window
that no extension covers, since it repeats in another document than the block's smallest, or nowhere, is looked for by a hash of its 50 words among
the other such windows.

Texts stay where they are: they are written once as a table of chunks, bucketed by chunk, and what travels are sorted hashes, delta-coded per
chunk and shard, and the surroundings of blocks. Words are known by 64 bits each. The probe hashes have 10 bits more than the number of blocks
needs, so a false hit costs an extension and changes nothing; 50-word windows that are looked for by hash are told apart by 96 bits.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import raw, shared_path, ship, slices, stash, unstash

WINDOW = 50
CHUNK_BYTES = 2 << 20
NO_ID = np.iinfo(np.int64).max
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[tuple[int, int], np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2^64."""
    size = 1 << max(16, n.bit_length())
    if (base, size) not in _powers:
        p = np.full(size, base, np.uint64)
        p[0] = 1
        _powers[base, size] = np.cumprod(p, dtype=np.uint64)
    return _powers[base, size][:n]


class Chunk:
    """Words of some texts, end to end, with rolling hashes."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]) -> None:
        self.ids, self.words = ids, [t.split() for t in texts]
        self.n = np.array([len(w) for w in self.words], np.int64)
        total = int(self.n.sum())
        self.hash = np.fromiter((xxhash.xxh64_intdigest(w) for ws in self.words for w in ws), np.uint64, total)
        self.end = np.cumsum(self.n)
        self.start = self.end - self.n
        self.left = np.repeat(self.end, self.n) - np.arange(total)
        self.doc = np.repeat(np.arange(len(texts)), self.n)

    def rolling(self, length: int, which: int = 0) -> np.ndarray:
        """Of the window at each place; meaningful where length words are left. The multiplier makes windows at all places comparable."""
        n, base = len(self.hash), _BASES[which]
        if n < length:
            return np.zeros(0, np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hash * _power(base, n), dtype=np.uint64)])
        h = (sums[length:] - sums[:-length]) * _power(pow(base, -1, 1 << 64), n)[: n - length + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def pack(a: np.ndarray) -> bytes:
    """Rising uint64 values as differences, byte plane by byte plane."""
    if not len(a):
        return b""
    d = np.diff(a, prepend=a[:1])
    width = max(1, (int(d.max()).bit_length() + 7) // 8)
    return bytes([width]) + int(a[0]).to_bytes(8, "little") + d.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(b, np.uint8, offset=9).reshape(b[0], -1)
    d = np.zeros((planes.shape[1], 8), np.uint8)
    d[:, : b[0]] = planes.T
    d = d.view(np.uint64)[:, 0]
    d[0] = int.from_bytes(b[1:9], "little")
    return np.cumsum(d, dtype=np.uint64)


def _found(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which x are in sorted_."""
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


_CHUNKS = pa.schema([("bid", pa.int64()), ("n_words", pa.int64()), ("blob", pa.binary())])
#: Between chunks and shards: what kind of message, keys that rise, and something for each key.
_ROW = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("bid", pa.int64()), ("keys", pa.binary()), ("more", pa.binary())])
_DDL = "kind int, shard long, bid long, keys binary, more binary"
#: A shard tells a chunk its matched probes and the smallest document of each, and the blocks of which that document is in the chunk; a chunk asks for
#: surroundings, or gives them; it tells itself what extensions cover, and asks for windows; a shard tells it those that are elsewhere.
MATCHED, OWN, WANT, GIVE, AROUND, COVERED, WINDOWS, ELSEWHERE = range(8)


def _to_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, limit=CHUNK_BYTES):
        ids, texts = part.column("doc_id").fill_null(NO_ID), raw(part.column("text"))
        sink = pa.BufferOutputStream()
        table = pa.table({"id": ids, "null": part.column("doc_id").is_null(), "text": pa.array(texts, pa.large_binary())})
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(table)
        blob = sink.getvalue().to_pybytes()
        bid = xxhash.xxh64_intdigest(blob) >> 1
        yield pa.RecordBatch.from_arrays([pa.array([bid]), pa.array([sum(len(t) for t in texts) // 2]), pa.array([blob])], schema=_CHUNKS)


def _open(blob: bytes) -> tuple[Chunk, np.ndarray]:
    table = pa.ipc.open_stream(blob).read_all()
    return Chunk(table["id"].to_numpy(), table["text"].to_pylist()), table["null"].to_numpy()


def _key(h: np.ndarray, bits: int) -> np.ndarray:
    return h >> np.uint64(64 - bits)


def _split(values: np.ndarray, shards: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, borders) of sorted values: shards are equal ranges of the hash."""
    shard = ((values >> np.uint64(bits - 32)) * np.uint64(shards)) >> np.uint64(32)
    cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(values) else np.zeros(0, np.int64)
    return shard[cut].astype(np.int64), np.r_[cut, len(values)]


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ROW)], schema=_ROW)


def _of(table: pa.Table, kind: int) -> list[tuple[np.ndarray, bytes]]:
    """(keys, more) of the messages of one kind."""
    return [(unpack(k), m) for t, k, m in zip(table["kind"].to_pylist(), table["keys"].to_pylist(), table["more"].to_pylist()) if t == kind]


def _joined(parts: list[tuple[np.ndarray, bytes]], dtype, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Keys of several messages, rising, and the values of each, a row of width."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros((0, width), dtype)
    keys = np.concatenate([k for k, _ in parts])
    values = np.concatenate([np.frombuffer(m, dtype).reshape(-1, width) for _, m in parts])
    order = np.argsort(keys, kind="stable")
    return keys[order], values[order]


def _probe(batches: Iterator[pa.RecordBatch], window: int, bits: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Every rolling window of block length, which of them are reference blocks, and whose."""
    block = (window + 1) // 2
    for batch in batches:
        for bid, blob in zip(batch.column("bid").to_pylist(), batch.column("blob").to_pylist()):
            c, _ = _open(blob)
            h = c.rolling(block)
            place, doc = np.arange(len(h)), c.doc[: len(h)]
            able = (c.left[: len(h)] >= block) & (c.n[doc] >= window)
            mark, ids = ((place - c.start[doc]) % block == 0)[able], c.ids[doc[able]]
            key = _key(h[able], bits)
            order = np.argsort(key, kind="stable")
            key, mark, ids = key[order], mark[order], ids[order]
            shard, cut = _split(key, shards, bits)
            more = [np.packbits(mark[a:b]).tobytes() + ids[a:b][mark[a:b]].tobytes() for a, b in zip(cut[:-1], cut[1:])]
            yield _table([(0, s, bid, pack(key[a:b]), m) for s, a, b, m in zip(shard.tolist(), cut[:-1], cut[1:], more)]).to_batches()[0] if len(shard) else pa.RecordBatch.from_pylist([], schema=_ROW)


def _match(table: pa.Table) -> pa.Table:
    """Of one shard: for each chunk its probes that hit a reference block which is also found elsewhere, with the block's smallest document."""
    shard, bids, probes = table["shard"][0].as_py(), table["bid"].to_pylist(), [unpack(b) for b in table["keys"].to_pylist()]
    marks = [np.unpackbits(np.frombuffer(m, np.uint8, (len(p) + 7) // 8))[: len(p)].astype(bool) for p, m in zip(probes, table["more"].to_pylist())]
    owned = [(p[m], np.frombuffer(x, np.int64, offset=(len(p) + 7) // 8)) for p, m, x in zip(probes, marks, table["more"].to_pylist())]
    keys, ids, whose = (np.concatenate(x) for x in ([k for k, _ in owned], [i for _, i in owned], [np.full(len(k), n) for n, (k, _) in enumerate(owned)]))
    order = np.lexsort((ids, keys))
    keys, ids, whose = keys[order], ids[order], whose[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    keys, ids, whose = keys[first], ids[first], whose[first]
    hits = [p[_found(keys, p)] for p in probes]
    key, count = np.unique(np.concatenate(hits), return_counts=True)
    twice = key[count > 1]
    rows = []
    for b, h in zip(bids, hits):
        if len(m := np.unique(h[_found(twice, h)])):
            rows.append((MATCHED, shard, b, pack(m), ids[np.searchsorted(keys, m)].tobytes()))
    again = _found(twice, keys)
    for n in np.unique(whose[again]):
        mine = again & (whose == n)
        rows.append((OWN, shard, bids[n], pack(keys[mine]), ids[mine].tobytes()))
    return _table(rows)


def _hits(c: Chunk, keys: np.ndarray, window: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, index into keys) of the rolling windows that are among the keys."""
    block = (window + 1) // 2
    h = c.rolling(block)
    if not len(keys) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = _key(h, bits)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    places = np.flatnonzero((keys[at] == key) & (c.left[: len(h)] >= block))
    return places, at[places]


def _around(c: Chunk, places: np.ndarray, window: int) -> np.ndarray:
    """Hashes of the words before each place's block, nearest first, and of those after it; 0 beyond the document."""
    block = (window + 1) // 2
    reach, doc = window - block, c.doc[places]
    steps = np.arange(reach)
    left, right = places[:, None] - 1 - steps, places[:, None] + block + steps
    most = max(0, len(c.hash) - 1)
    before = np.where(left >= c.start[doc][:, None], c.hash[np.maximum(left, 0)], np.uint64(0))
    after = np.where(right < c.end[doc][:, None], c.hash[np.minimum(right, most)], np.uint64(0))
    return np.concatenate([before, after], axis=1)


def _choose(window: int, bits: int, shards: int):
    """A chunk asks for the surroundings of its hits, one of every block length of places, and gives those of its own blocks."""
    block = (window + 1) // 2

    def choose(chunks: pa.Table, told: pa.Table) -> pa.Table:
        keys, least = _joined(_of(told, MATCHED), np.int64)
        own, whose = _joined(_of(told, OWN), np.int64)
        rows: list[tuple] = []
        for bid, blob in list(zip(chunks["bid"].to_pylist(), chunks["blob"].to_pylist()))[: 1 if len(keys) + len(own) else 0]:  # chunks of one bid are alike
            c, _ = _open(blob)
            at, k = _hits(c, keys, window, bits)
            some = least[k, 0] < c.ids[c.doc[at]]
            at, k = at[some], k[some]
            cell = (at - c.start[c.doc[at]]) // block + c.start[c.doc[at]]  # a document's cells are fewer than its words
            order = np.lexsort((at, least[k, 0], cell))
            lead = order[np.flatnonzero(np.r_[True, cell[order][1:] != cell[order][:-1]])] if len(order) else order
            chosen = np.unique(k[lead])
            shard, cut = _split(keys[chosen], shards, bits)
            rows += [(WANT, s, bid, pack(keys[chosen][a:b]), b"") for s, a, b in zip(shard.tolist(), cut[:-1], cut[1:])]
            at, k = _hits(c, own, window, bits)
            mine = ((at - c.start[c.doc[at]]) % block == 0) & (c.ids[c.doc[at]] == whose[k, 0])
            k, lead = np.unique(k[mine], return_index=True)
            at = at[mine][lead]
            told_ = np.concatenate([whose[k].view(np.uint64), _around(c, at, window)], axis=1)
            shard, cut = _split(own[k], shards, bits)
            rows += [(GIVE, s, bid, pack(own[k][a:b]), told_[a:b].tobytes()) for s, a, b in zip(shard.tolist(), cut[:-1], cut[1:])]
        return _table(rows)

    return choose


def _route(window: int):
    """Of one shard: the surroundings that each chunk asked for."""
    width = 1 + 2 * (window - (window + 1) // 2)

    def route(table: pa.Table) -> pa.Table:
        keys, around = _joined(_of(table, GIVE), np.uint64, width)
        rows = []
        for kind, bid, k in zip(table["kind"].to_pylist(), table["bid"].to_pylist(), table["keys"].to_pylist()):
            if kind == WANT and len(keys):
                wanted = unpack(k)
                wanted = wanted[_found(keys, wanted)]
                rows.append((AROUND, None, bid, pack(wanted), around[np.searchsorted(keys, wanted)].tobytes()))
        return _table(rows)

    return route


def extended(c: Chunk, keys: np.ndarray, around: np.ndarray, window: int, bits: int, step: int = 1 << 14) -> np.ndarray:
    """Which windows of a chunk the hits of these blocks cover, each extended word by word along the surroundings of the block in a smaller document."""
    block = (window + 1) // 2
    reach = window - block
    starts = np.zeros(len(c.hash) + 2, np.int64)
    at, k = _hits(c, keys, window, bits)
    if len(at):
        smaller = around[k, 0].view(np.int64) < c.ids[c.doc[at]]
        at, k = at[smaller], k[smaller]
    for a in range(0, len(at), step):
        place, there = at[a : a + step], around[k[a : a + step], 1:]
        same = (_around(c, place, window) == there) & (there != 0)
        left = np.logical_and.accumulate(same[:, :reach], axis=1).sum(1)
        right = np.logical_and.accumulate(same[:, reach:], axis=1).sum(1)
        whole = left + block + right >= window
        first, n = (place - left)[whole], (left + block + right - window + 1)[whole]
        np.add.at(starts, first, 1)
        np.add.at(starts, first + n, -1)
    return np.cumsum(starts)[: max(0, len(c.hash) - window + 1)] > 0


def _candidates(c: Chunk, places: np.ndarray, window: int) -> np.ndarray:
    """Which windows hold a matched block; places: the hits."""
    block, n = (window + 1) // 2, max(0, len(c.hash) - window + 1)
    hit = np.zeros(len(c.hash) + 1, np.int64)
    hit[places + 1] = 1
    sums = np.cumsum(hit)
    span = window - block + 1
    return (sums[span : span + n] > sums[:n]) & (c.left[:n] >= window)


def _extend(window: int, bits: int, shards: int):
    """A chunk extends its hits, and asks for the windows that hold a matched block and aren't covered by then."""

    def ask(chunks: pa.Table, told: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        matched, _ = _joined(_of(told, MATCHED), np.int64)
        keys, around = _joined(_of(told, AROUND), np.uint64, 1 + 2 * (window - (window + 1) // 2))
        for bid, blob in list(zip(chunks["bid"].to_pylist(), chunks["blob"].to_pylist()))[: 1 if len(matched) else 0]:
            c, _ = _open(blob)
            done = extended(c, keys, around, window, bits)
            if done.any():
                rows.append((COVERED, None, bid, pack(np.flatnonzero(done).astype(np.uint64)), b""))
            at = np.flatnonzero(_candidates(c, _hits(c, matched, window, bits)[0], window) & ~done)
            h1, h2, ids = c.rolling(window)[at], c.rolling(window, 1)[at] >> np.uint64(32), c.ids[c.doc[at]]
            order = np.lexsort((ids, h2, h1))
            h1, h2, ids = h1[order], h2[order], ids[order]
            first = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]) if len(at) else np.zeros(0, np.int64)
            last = np.r_[first[1:], len(at)][: len(first)] - 1
            names, low = np.unique(ids, return_inverse=True)
            h1, h2, low, high = h1[first], h2[first].astype(np.uint32), low[first].astype(np.uint32), low[last].astype(np.uint32)
            shard, cut = _split(h1, shards, 64)
            for s, a, b in zip(shard.tolist(), cut[:-1], cut[1:]):
                used, place = np.unique(np.r_[low[a:b], high[a:b]], return_inverse=True)
                kind = np.uint16 if len(used) < 1 << 16 else np.uint32
                rows.append((WINDOWS, s, bid, pack(h1[a:b]), len(used).to_bytes(4, "little") + names[used].tobytes() + place.astype(kind).tobytes() + h2[a:b].tobytes()))
        return _table(rows)

    return ask


def _first(table: pa.Table) -> pa.Table:
    """Of one shard: for each chunk its windows that start in a smaller document than one of its own, with the smallest and the rest of the hash."""
    parts = []
    for k, (keys, more) in enumerate(zip(table["keys"].to_pylist(), table["more"].to_pylist())):
        h1, n = unpack(keys), int.from_bytes(more[:4], "little")
        names = np.frombuffer(more, np.int64, n, 4)
        kind = np.uint16 if n < 1 << 16 else np.uint32
        at = 4 + 8 * n
        place = np.frombuffer(more, kind, 2 * len(h1), at)
        h2 = np.frombuffer(more, np.uint32, len(h1), at + 2 * len(h1) * kind().itemsize)
        parts.append((h1, h2, names[place[: len(h1)]], names[place[len(h1) :]], np.full(len(h1), k)))
    h1, h2, low, high, chunk = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((low, h2, h1))
    s1, s2 = h1[order], h2[order]
    new = np.r_[True, (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])]
    least = low[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    keep = least < high[order]
    back = order[keep]
    by = np.argsort(chunk[back], kind="stable")  # hashes stay sorted within each chunk
    chunk, s1, told = chunk[back][by], s1[keep][by], np.stack([least[keep][by].view(np.uint64), s2[keep][by].astype(np.uint64)], axis=1)
    bids = np.array(table["bid"].to_pylist(), np.int64)
    return _table([(ELSEWHERE, None, int(bids[k]), pack(s1[a:b]), told[a:b].tobytes()) for k, a, b in zip(*(lambda u, i: (u, i, np.r_[i[1:], len(chunk)]))(*np.unique(chunk, return_index=True)))])


def _elsewhere(c: Chunk, keys: np.ndarray, told: np.ndarray, window: int) -> np.ndarray:
    """Which windows start in a smaller document, by 96 bits of hash; several keys may share the first 64."""
    h1 = c.rolling(window)
    found = np.zeros(len(h1), bool)
    if not len(keys):
        return found
    h2, ids = c.rolling(window, 1) >> np.uint64(32), c.ids[c.doc[: len(h1)]]
    at, end = np.searchsorted(keys, h1, side="left"), np.searchsorted(keys, h1, side="right")
    open_ = np.flatnonzero((at < end) & (c.left[: len(h1)] >= window))
    while len(open_):
        found[open_] |= (told[at[open_], 1] == h2[open_]) & (told[at[open_], 0].view(np.int64) < ids[open_])
        at[open_] += 1
        open_ = open_[at[open_] < end[open_]]
    return found


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])
_RESULT_DDL = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _cut(window: int, with_text: bool):
    def cut(chunks: pa.Table, told: pa.Table) -> pa.Table:
        keys, least = _joined(_of(told, ELSEWHERE), np.uint64, 2)
        covered = [k for k, _ in _of(told, COVERED)]
        done = []
        for blob in chunks["blob"].to_pylist():
            c, null = _open(blob)
            gone = np.zeros(len(c.hash), bool)
            if len(c.hash) >= window and (len(keys) or covered):
                here = _elsewhere(c, keys, least, window)
                for places in covered:
                    here[places.astype(np.int64)] = True
                cover = np.zeros(len(gone) + 1, np.int64)
                cover[: len(here)] += here
                cover[window : window + len(here)] -= here
                gone = np.cumsum(cover)[:-1] > 0
            removed = np.add.reduceat(np.r_[gone, False], np.minimum(c.start, len(gone)), dtype=np.int64) if len(c.n) else np.zeros(0, np.int64)
            removed[c.n == 0] = 0
            for k, (w, a, b, r) in enumerate(zip(c.words, c.start, c.end, removed.tolist())):
                kept = b" ".join(w if not r else [x for x, g in zip(w, gone[a:b].tolist()) if not g])
                done.append((None if null[k] else int(c.ids[k]), len(w), r, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
        return pa.Table.from_arrays([pa.array([d[i] for d in done], f.type) for i, f in enumerate(_RESULT)], schema=_RESULT)

    return cut


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for each row of docs; kept, the words that stay joined by a space, only with_text.

    A word goes if a window of that many words covers it whose sequence also starts in a document with a smaller id. Rows of the same id, and repeats within a document, don't
    remove each other. A null id counts as larger than all others. Null, empty and short texts keep all they have; an empty table gives none. Other columns aren't read.
    """
    spark = docs.sparkSession
    ship(spark)
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"codesieve_chunks_{uuid.uuid4().hex}"
    chunks = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_to_chunks, "bid long, n_words long, blob binary")
    chunks.write.bucketBy(buckets, "bid").option("path", shared_path(spark, name)).option("compression", "none").saveAsTable(name)
    chunks = spark.table(name)
    words = chunks.agg(F.sum("n_words")).first()[0] or 1
    bits = min(60, max(36, math.ceil(math.log2(words / ((window + 1) // 2) + 1)) + 10))
    advised = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"))
    shards = max(buckets, math.ceil(6 * words / advised))  # a probe takes about 6 bytes, so a shard about what a task should read
    keyed = chunks.select("bid", "blob")

    def by_chunk(told: DataFrame, do) -> DataFrame:
        return keyed.groupBy("bid").cogroup(told.repartition(buckets, "bid").groupBy("bid")).applyInArrow(do, _DDL)

    def by_shard(asked: DataFrame, do) -> DataFrame:
        return asked.repartition(shards, "shard").groupBy("shard").applyInArrow(do, _DDL)

    matched = stash(by_shard(keyed.mapInArrow(lambda b: _probe(b, window, bits, shards), _DDL), _match), "matched")
    around = by_shard(by_chunk(matched, _choose(window, bits, shards)), _route(window))
    asked = stash(by_chunk(matched.where(F.col("kind") == MATCHED).unionByName(around), _extend(window, bits, shards)), "asked")
    firsts = by_shard(asked.where(F.col("kind") == WINDOWS), _first)
    told = stash(asked.where(F.col("kind") == COVERED).unionByName(firsts), "told")
    unstash(matched, asked)
    result = keyed.groupBy("bid").cogroup(told.repartition(buckets, "bid").groupBy("bid")).applyInArrow(_cut(window, with_text), _RESULT_DDL)
    return result if with_text else result.drop("kept")
