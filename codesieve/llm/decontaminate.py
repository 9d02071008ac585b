"""Benchmark decontamination with a stored positional inverted index.

One pass over the documents writes the index: for each chunk of documents the postings (term -> rising places) of the terms that the benchmark may
have. Phrases and postings meet in the cluster: a phrase's terms are ranked by their counts over the whole corpus, the phrase joins the chunks that
hold its rarest term, keeps those that hold the next one too, and in each of them the posting list of the rarest term, moved back by the term's
offset, is intersected with the lists of the other terms, from rare to frequent. Nothing of the benchmark is sent to all executors but a bit mask of
MASK_BITS, which says which words can't be its terms; a fuller mask stores more postings and changes no result. Terms and phrases are known by
64 bits of hash; an exact phrase is a sequence of up to eight of them, so that no false one is to be expected in any corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import again, out, raw, ship, slices, stash, unstash, whole

#: On lower-cased UTF-8, where A-Z are gone, these bytes are the runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall
WINDOW = 8
MASK_BITS = 1 << 24
#: Words whose hashes a worker keeps, and phrases that it makes at once.
KEPT, STEP = 1 << 19, 10_000


def words(text: bytes) -> list[bytes]:
    return _WORDS(text.lower())


def term(word: bytes) -> int:
    """A word's number: 63 bits of hash, never 0."""
    return (xxhash.xxh64_intdigest(word) >> 1) or 1


# --- The benchmark ----------------------------------------------------------------------------------------------------------


def _windows(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        for item, text in zip(part.column("item").to_pylist(), raw(part.column("text"))):
            t = [term(w) for w in words(text)]
            starts = range(max(1, len(t) - window + 1) if t else 0)
            for k in range(0, len(starts), STEP):
                found = [t[s : s + window] for s in starts[k : k + STEP]]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found)), pa.array(found, pa.list_(pa.int64()))], names=["item", "terms"])


def phrases(bench: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item, pid, terms): the windows of each item; an item of fewer words, but not none, is one."""
    rows = bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda b: _windows(window, b), "item string, terms array<long>").distinct().select("item", F.xxhash64("terms").alias("pid"), "terms")


def mask_of(terms: DataFrame) -> np.ndarray:
    """Bits of the places that the terms of a table (term) have; MASK_BITS / 8 bytes, whatever the number of terms."""
    place = F.col("term").bitwiseAND(F.lit(MASK_BITS - 1)) + 1
    rows = terms.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    mask = np.zeros(MASK_BITS // 8, np.uint8)
    for r in rows:
        mask[(r["at"] - 1) * 4096 : r["at"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return mask


# --- The index --------------------------------------------------------------------------------------------------------------


class Terms(dict):
    """Word -> its number, or 0 if the mask rules it out; forgets all at KEPT words."""

    def __init__(self, mask: np.ndarray) -> None:
        self.mask, self.last = mask.tobytes(), 8 * len(mask) - 1

    def __missing__(self, word: bytes) -> int:
        t = term(word)
        at = t & self.last
        if len(self) >= KEPT:
            self.clear()
        self[word] = t = t if self.mask[at >> 3] >> (at & 7) & 1 else 0
        return t


_INDEX_DDL = "bid long, ids binary, none binary, hashes binary, n binary, terms array<long>, counts array<int>, places binary"
_INDEX = pa.schema([("bid", pa.int64()), ("ids", pa.binary()), ("none", pa.binary()), ("hashes", pa.binary()), ("n", pa.binary()), ("terms", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("places", pa.binary())])


def _post(mask, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, context, k = Terms(mask.value), TaskContext.get(), 0
    first = (context.partitionId() if context else 0) << 33
    for part in slices(batches):
        texts = [words(t) for t in raw(part.column("text"))]
        n = np.array([len(t) for t in texts], np.int64)
        start = np.cumsum(n + 1) - n - 1  # a place between two texts holds no term
        flat = np.zeros(int(n.sum()) + len(n), np.int64)
        for t, at in zip(texts, start.tolist()):
            flat[at : at + len(t)] = np.fromiter(map(known.__getitem__, t), np.int64, len(t))
        held = np.flatnonzero(flat)
        held = held[np.argsort(flat[held], kind="stable")]
        terms, counts = np.unique(flat[held], return_counts=True)
        delta = np.diff(held, prepend=0)
        heads = np.cumsum(counts) - counts
        delta[heads] = held[heads]
        ids = part.column("doc_id")
        row = {"bid": first + k, "ids": ids.fill_null(0).to_numpy().tobytes(), "none": np.packbits(ids.is_null().to_numpy(zero_copy_only=False)).tobytes(), "hashes": part.column("h").to_numpy().tobytes()}
        yield out({c: [v] for c, v in row.items()} | {"n": [n.tobytes()], "terms": [terms], "counts": [counts.astype(np.int32)], "places": [delta.astype(np.uint32).tobytes()]}, _INDEX)
        k += 1


def index(docs: DataFrame, mask: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index, written: a row for each chunk of about 2 MB of text (a longer text is a chunk) with its documents and postings."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(mask)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    return stash(rows.mapInArrow(lambda b: _post(sent, b), _INDEX_DDL), "postings")


class Postings:
    """One row of the index."""

    def __init__(self, row: dict) -> None:
        self.n = np.frombuffer(row["n"], np.int64)
        self.start = np.cumsum(self.n + 1) - self.n - 1
        none = np.unpackbits(np.frombuffer(row["none"], np.uint8))[: len(self.n)]
        self.ids = [None if x else int(i) for i, x in zip(np.frombuffer(row["ids"], np.int64), none)]
        self.hashes = np.frombuffer(row["hashes"], np.int64)
        counts, places = np.array(row["counts"], np.int64), np.cumsum(np.frombuffer(row["places"], np.uint32), dtype=np.int64)
        heads = np.cumsum(counts) - counts
        before = np.concatenate([[0], places])[heads]  # what the lists before a list's first place add up to
        self.places = places - np.repeat(before, counts)
        self.at = {t: (a, a + c) for t, a, c in zip(row["terms"], heads.tolist(), counts.tolist())}

    def list(self, t: int) -> np.ndarray:
        a, b = self.at.get(t, (0, 0))
        return self.places[a:b]

    def phrase(self, terms: list[int], order: list[int]) -> np.ndarray:
        """Places where the terms follow one another: lists moved back by their offsets, intersected in this order."""
        start = self.list(terms[order[0]]) - order[0]
        for k in order[1:]:
            if not len(start):
                break
            other = self.list(terms[k]) - k
            if not len(other):
                return other
            start = start[other[np.minimum(np.searchsorted(other, start), len(other) - 1)] == start]
        return start

    def near(self, terms: set[int], span: int) -> np.ndarray:
        """Every place of one of the terms from which all of them follow, in any order, within span words of one text."""
        lists = sorted((self.list(t) for t in terms), key=len)
        if not lists or not len(lists[0]):
            return np.zeros(0, np.int64)
        at = np.unique(np.concatenate(lists))
        doc = self.document(at)
        stop = np.minimum(at + span, self.start[doc] + self.n[doc])
        for x in lists:
            k = np.minimum(np.searchsorted(x, at), len(x) - 1)
            good = (x[k] >= at) & (x[k] < stop)
            at, stop = at[good], stop[good]
        return at

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, places, side="right") - 1


# --- Search -----------------------------------------------------------------------------------------------------------------

_FOUND = pa.schema([("bid", pa.int64()), ("k", pa.int32()), ("doc_id", pa.int64()), ("h", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.int64())), ("pids", pa.list_(pa.int64()))])
_FOUND_DDL = "bid long, k int, doc_id long, h long, n_words long, runs array<long>, pids array<long>"


def _match(chunk: pa.Table, asked: pa.Table) -> pa.Table:
    """The documents of one chunk, with the merged word ranges that the asked phrases cover and those phrases."""
    p = Postings(chunk.to_pylist()[0])
    places, lengths, pids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for pid, terms, order in zip(*(asked.column(c).to_pylist() for c in ("pid", "terms", "places"))):
        if len(at := p.phrase(terms, order)):
            places.append(at)
            lengths.append(np.full(len(at), len(terms)))
            pids.append(np.full(len(at), pid))
    at, size, pid = (np.concatenate(x) for x in (places, lengths, pids))
    doc, order = p.document(at), np.argsort(at, kind="stable")
    runs: list[list[int]] = [[] for _ in p.ids]
    shown: list[set[int]] = [set() for _ in p.ids]
    for d, s, n, x in zip(doc[order].tolist(), (at - p.start[doc])[order].tolist(), size[order].tolist(), pid[order].tolist()):
        r = runs[d]
        if r and s <= r[-1]:
            r[-1] = max(r[-1], s + n)
        else:
            r += (s, s + n)
        shown[d].add(x)
    columns = ([chunk["bid"][0].as_py()] * len(p.ids), range(len(p.ids)), p.ids, p.hashes, p.n, runs, [sorted(x) for x in shown])
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)


def candidates(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """(bid, pid, terms, places): the chunks that hold the two rarest terms of a phrase; places are the terms' offsets from the rarest term on.

    wanted: (pid, terms). A phrase with a term that the corpus hasn't joins nothing.
    """
    held = postings.select("bid", F.explode("terms").alias("term"))
    counts = postings.select(F.explode(F.arrays_zip("terms", "counts")).alias("c")).groupBy(F.col("c.terms").alias("term")).agg(F.sum("c.counts").alias("count"))
    each = wanted.select("pid", F.size("terms").alias("size"), F.posexplode("terms").alias("place", "term")).join(counts, "term")
    ranked = each.groupBy("pid", "size").agg(F.sort_array(F.collect_list(F.struct("count", "place", "term"))).alias("by")).where(F.size("by") == F.col("size"))
    ranked = ranked.join(wanted, "pid").select("pid", "terms", F.col("by.place").alias("places"), F.get("by", F.lit(0))["term"].alias("rarest"), F.coalesce(F.get("by", F.lit(1))["term"], F.get("by", F.lit(0))["term"]).alias("next"))
    ranked = stash(ranked, "phrases")
    found = ranked.join(held.withColumnRenamed("term", "rarest"), "rarest")
    return found.join(held.withColumnRenamed("term", "next"), ["bid", "next"], "left_semi").select("bid", "pid", "terms", "places")


def search(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """(doc_id, h, n_words, runs, items) for each row of docs: h is the text's hash, runs the merged word ranges [start, end, start, end, ...] that exact phrases cover.

    A phrase is a window of an item, or the whole item if that is shorter; an item without words has none. Null or empty texts
    have no words and no hits; a null item_id is the item 'null'. Repeated rows each get their row. Other columns aren't read. An empty benchmark
    hits nothing, an empty table gives no row.
    """
    ship(docs.sparkSession)
    owned = stash(phrases(bench, item_col, text_col, window), "windows")
    wanted = owned.select("pid", "terms").dropDuplicates(["pid"])
    postings = index(docs, mask_of(owned.select(F.explode("terms").alias("term")).distinct()), id_col, text_col)
    asked = candidates(again(postings), wanted)
    found = stash(postings.groupBy("bid").cogroup(asked.groupBy("bid")).applyInArrow(_match, _FOUND_DDL), "found")
    unstash(postings)
    items = found.select("bid", "k", F.explode("pids").alias("pid")).join(owned.select("pid", "item"), "pid").groupBy("bid", "k").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return found.join(items, ["bid", "k"], "left").select("doc_id", "h", "n_words", "runs", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination(docs: DataFrame, bench: DataFrame, *, least_items: int = 2, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs; see search()."""
    n_hit = F.expr("aggregate(sequence(0, cast(size(runs) / 2 as int)), 0L, (a, k) -> a + coalesce(get(runs, 2 * k + 1) - get(runs, 2 * k), 0L))")
    return search(docs, bench, **options).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= least_items).alias("contaminated")
    )


def proximity(docs: DataFrame, terms: list[str], span: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, position) of each place where all the terms follow within span words; see Postings.near. Terms are matched as words() gives them."""
    wanted = {term(w) for t in terms for w in words(t.encode())}
    mask = np.zeros(MASK_BITS, bool)
    mask[[t & (MASK_BITS - 1) for t in wanted]] = True

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                p = Postings(row)
                at = p.near(wanted, span)
                doc = p.document(at)
                yield pa.RecordBatch.from_arrays([pa.array([p.ids[d] for d in doc.tolist()], pa.int64()), pa.array(at - p.start[doc])], names=["doc_id", "position"])

    return index(docs, np.packbits(mask, bitorder="little"), id_col, text_col).mapInArrow(find, "doc_id long, position long")


def clean(docs: DataFrame, bench: DataFrame, *, least_items: int = 1, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that hold phrases of fewer than least_items items. A row without text has none and stays; of repeated rows all stay or go.

    docs may have any other columns, whatever their names.
    """
    hits = search(docs, bench, id_col=id_col, text_col=text_col, **options).where(F.size("items") >= least_items)
    dirty = stash(hits.select("doc_id", "h").distinct(), "dirty")
    rows = docs.select(whole(docs), F.col(id_col).cast("long").alias("i"), F.xxhash64(text_col).alias("t"))
    return rows.join(dirty, F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("h")), "left_anti").select("row.*")
