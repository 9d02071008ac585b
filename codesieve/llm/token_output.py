"""Token ids in binary files: canonical, length-limited Huffman codes of ids from their global counts.

A file holds the documents of one range of ids in order: a head with the code lengths, each document's bits from a byte border on, and a foot
with the documents' ids, numbers of tokens and byte offsets and, for every block of BLOCK ids, the bit offset at which it can be decoded on its
own. Decoding looks up LIMIT bits in a table and steps all blocks of a file at once.
"""

from __future__ import annotations

import heapq
import json
import math
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import give_back, raw, shared_path, ship, slices, stash, unstash

BLOCK = 512
LIMIT = 16
END_ID = 0
MAGIC = b"CSIDHUF1"
CACHE = 450_000
#: Token ids of one range of document ids, about, bytes of a file, and ids that a reader holds at once.
RANGE_IDS, FILE_BYTES, READ_IDS = 64 << 20, 64 << 20, 4 << 20
_encoders: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: How the byte-level pattern cuts a piece that begins with its only space.
_PRETOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}


class Kept(dict):
    """What was asked for lately: at 2 * CACHE entries those not used since CACHE go."""

    def __init__(self, make) -> None:
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value

    def rest(self) -> None:
        """Between tasks a worker holds nothing."""
        self.older = {}
        self.clear()


class Encoder:
    """Ids of texts by the tokenizers library. The byte-level pattern always splits before a space that a non-space follows, so
    pieces between such spaces are encoded once and kept; a text with any other space or with an added token is encoded as it is."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        #: Strings that the library takes as one id wherever they are: a text with any of them is encoded as it is.
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values() if t.content]
        kind = json.loads(open(path, encoding="utf-8").read())
        pre = kind.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not kind.get("normalizer") and kind["model"]["type"] == "BPE" and not kind["model"].get("dropout")
        self.type = np.dtype(np.uint16 if self.model.get_vocab_size() <= 1 << 16 else np.uint32)
        self.letters, self.code = _byte_letters(), "HI"[self.type.itemsize // 4]
        self.tokenize = self.model.model.tokenize
        self.marks = {c: self._token(c) for c in ".,;:!?"}
        self.pieces, self.tokens = Kept(self._piece), Kept(self._token)

    def _token(self, token: str) -> bytes:
        """Ids of what the pattern takes as one: a space at its start and printable ASCII stand for their bytes as they are."""
        plain = token.isascii() and token.isprintable()
        letters = (f"\u0120{token[1:]}" if token[0] == " " else token) if plain else token.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.model.tokenize(letters)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isalpha():
            letters = f"\u0120{piece}" if piece.isascii() else "\u0120" + piece.encode().decode("latin-1").translate(self.letters)
            return array(self.code, [t.id for t in self.tokenize(letters)]).tobytes()
        mark = self.marks.get(piece[-1:])
        if mark is not None and (core := piece[:-1]).isalpha():
            return self.pieces[core] + mark
        return b"".join([self.pieces[t[1:]] if t[0] == " " and t[1:].isalpha() else self.tokens[t] for t in _PRETOKENS(" " + piece)])

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, each with end_id at its end; numbers of ids). Each distinct piece of the array is looked up once."""
        end = np.array([end_id], self.type).tobytes()
        if not self.by_piece:
            return self._flat([x + end for x in self._bytes(texts.to_pylist())])
        lists = pc.split_pattern(texts, " ")
        first, values = np.diff(lists.offsets.to_numpy()), lists.flatten()
        docs, count, at = len(texts), first, np.cumsum(first) - first
        is_head = np.zeros(len(values), bool)
        is_head[at] = True
        heads, pieces = values.filter(pa.array(is_head)).dictionary_encode(), values.filter(pa.array(~is_head)).dictionary_encode()
        distinct = pieces.dictionary
        odd = np.flatnonzero(pc.or_(pc.equal(pc.binary_length(distinct), 0), pc.utf8_is_space(pc.utf8_slice_codeunits(distinct, 0, 1))).to_numpy(zero_copy_only=False))
        known = list(map(self.pieces.__getitem__, distinct.to_pylist()))
        table = [*known, *self._bytes(heads.dictionary.to_pylist()), end]
        row = np.empty(len(values) + docs, np.int32)
        place = np.arange(len(values)) + np.repeat(np.arange(docs), count)
        row[place[~is_head]] = pieces.indices.to_numpy()
        row[place[is_head]] = heads.indices.to_numpy() + len(known)
        row[at + count + np.arange(docs)] = len(table) - 1
        size = np.fromiter(map(len, table), np.int32, len(table)) // self.type.itemsize
        flat = np.frombuffer(b"".join(table), self.type)
        sizes = size[row]
        kind = np.int32 if sizes.sum(dtype=np.int64) < 1 << 31 else np.int64
        ends = np.cumsum(sizes, dtype=kind)
        ids = flat[np.repeat((np.cumsum(size, dtype=kind) - size)[row] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=kind)]
        n = np.add.reduceat(sizes, at + np.arange(docs), dtype=np.int64) if docs else sizes.astype(np.int64)
        added = np.zeros(docs, bool)
        for token in self.added:
            added |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not len(odd) and not added.any():
            return ids, n
        added[np.searchsorted(at, np.flatnonzero(~is_head)[np.isin(pieces.indices.to_numpy(), odd)], side="right") - 1] = True
        spoilt = np.flatnonzero(added)
        parts = np.split(ids, np.cumsum(n)[:-1])
        whole = self._bytes(texts.take(pa.array(spoilt)).to_pylist())
        each = [p.tobytes() for p in parts]
        for k, x in zip(spoilt.tolist(), whole):
            each[k] = x + end
        return self._flat(each)

    def _flat(self, each: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(each), self.type), np.array([len(x) for x in each], np.int64) // self.type.itemsize


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each id (0: unused) by package-merge, which is optimal under the limit."""
    used = np.flatnonzero(counts)
    if len(used) > 1 << limit:
        raise ValueError("more ids in use than codes of that length")
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) == 1:
        lengths[used] = 1
    if len(used) < 2:
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(object)
    # Level by level: of the sorted list of leaves and packages, only which entries are leaves and how many are taken matters.
    leaf, packages, levels = list(weights), [], []
    for _ in range(limit):
        merged = list(heapq.merge(((w, 0) for w in leaf), ((w, 1) for w in packages)))
        levels.append(np.array([kind == 0 for _, kind in merged]))
        packages = [merged[k][0] + merged[k + 1][0] for k in range(0, len(merged) - 1, 2)]
    take, n = 2 * (len(used) - 1), np.zeros(len(used), np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        n[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = n
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for k in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        if n := int(lengths[k]):
            code <<= n - last if last else 0
            codes[k], last = code, n
            code += 1
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """(id << 5 | bits) for every possible next limit bits."""
    table, at = np.zeros(1 << limit, np.uint32), 0
    for k in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        if n := int(lengths[k]):
            span = 1 << (limit - n)
            table[at : at + span] = k << 5 | n
            at += span
    return table


def put(ids: np.ndarray, n: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[list[bytes], list[np.ndarray]]:
    """Of documents with n ids each, end to end: their bits, and the bit offsets of their blocks."""
    if not len(ids):
        return [b""] * len(n), [np.zeros(0, np.uint32)] * len(n)
    kind = np.int32 if len(ids) < 1 << 26 else np.int64
    size, code = lengths.astype(kind)[ids], codes.astype(np.uint32)[ids]
    ends = np.cumsum(size, dtype=kind)
    first = np.cumsum(n) - n
    bounds = np.concatenate([np.zeros(1, kind), ends])
    bits = (bounds[first + n] - bounds[first]).astype(np.int64)
    whole = (bits + 7) // 8
    base = 8 * (np.cumsum(whole) - whole)
    at = ends - size + np.repeat((base - bounds[first]).astype(kind), n)
    word, shift = at >> 5, 32 - (at & 31) - size
    main = np.where(shift >= 0, code << np.maximum(shift, 0).astype(np.uint32), code >> np.maximum(-shift, 0).astype(np.uint32))
    lead = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words = np.zeros(int(word[-1]) + 2, np.uint32)
    words[word[lead]] = np.bitwise_or.reduceat(main, lead)
    over = np.flatnonzero(shift < 0)
    words[word[over] + 1] |= code[over] << (32 + shift[over]).astype(np.uint32)
    stream = words.byteswap().tobytes()
    payloads = [stream[b : b + w] for b, w in zip((base // 8).tolist(), whole.tolist())]
    marks = [(at[f : f + k : BLOCK] - b).astype(np.uint64) for f, k, b in zip(first.tolist(), n.tolist(), base.tolist())]
    return payloads, marks


def get(stream: np.ndarray, offsets: np.ndarray, n: np.ndarray, table: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Ids of blocks that start at these bits with n ids each, end to end. All blocks step together, the longest first."""
    padded = np.concatenate([stream, np.zeros(8, np.uint8)]).astype(np.uint32)
    words = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
    order = np.argsort(-n, kind="stable")
    at, count, place = offsets[order].astype(np.int64), n[order], (np.cumsum(n) - n)[order]
    result, mask = np.zeros(int(n.sum()), np.uint32), np.uint32((1 << limit) - 1)
    for step in range(int(count[0]) if len(count) else 0):
        k = int(np.searchsorted(-count, -step, side="left"))
        at, place = at[:k], place[:k]
        entry = table[(words[at >> 3] >> (32 - limit - (at & 7)).astype(np.uint32)) & mask]
        result[place + step] = entry >> 5
        at = at + (entry & 31)
    return result


#: The last row of a task has no document but the task's counts (id, times) of all ids.
_IDS_DDL = "doc_id long, tie long, n long, ids binary, id array<int>, times array<long>"
_IDS = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("id", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])


def _tokenize(path: str, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    e = encoder(path)
    total = np.zeros(max(e.model.get_vocab_size(), end_id + 1), np.int64)
    for part in slices(batches, limit=8 << 20):
        ids, n = e.encode(part.column("text").fill_null(""), end_id)
        total += np.bincount(ids, minlength=len(total))
        offsets = np.concatenate([[0], np.cumsum(n)]) * e.type.itemsize
        blobs = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), pa.array(n), blobs, pa.nulls(len(n), _IDS.field("id").type), pa.nulls(len(n), _IDS.field("times").type)], schema=_IDS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_pylist([{"id": used.tolist(), "times": total[used].tolist()}], schema=_IDS)
    e.pieces.rest()
    e.tokens.rest()
    give_back()


def _range(doc: pa.Array, tie: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The range of each row by id; rows of one hot id share its ranges, in the order of tie."""
    v = doc.fill_null(np.iinfo(np.int64).max).to_numpy()
    low, high = np.searchsorted(edges, v, side="left"), np.searchsorted(edges, v, side="right")
    return low + (tie.view(np.uint64) >> np.uint64(33)).astype(np.int64) * (high - low + 1) // (1 << 31)


_CODED_DDL = "rid int, doc_id long, tie long, n long, bits binary, marks binary"
_CODED = pa.schema([("rid", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("marks", pa.binary())])


def _encode(kind: str, code, edges, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lengths = code.value
    codes = canonical(lengths)
    for part in slices(batches, "ids", 1 << 18):
        ids, n = np.frombuffer(b"".join(raw(part.column("ids"))), kind), part.column("n").to_numpy()
        bits, marks = put(ids, n, lengths, codes)
        doc, tie = part.column("doc_id"), part.column("tie")
        rid = _range(doc, tie.to_numpy(), edges.value)
        yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int32()), doc, tie, part.column("n"), pa.array(bits, pa.binary()), pa.array([m.tobytes() for m in marks], pa.binary())], schema=_CODED)


class Writer:
    """One file: head, bits as they come, foot."""

    def __init__(self, folder: str, rid: int, part: int, lengths: np.ndarray) -> None:
        self.rid, self.part, self.path = rid, part, f"{folder}/ids-{rid:08d}-{part:06d}-{uuid.uuid4().hex}.huf"
        system, path = fs.FileSystem.from_uri(self.path)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(path)
        table = zlib.compress(lengths.tobytes())
        self.size = self.out.write(MAGIC + struct.pack("<II", len(lengths), len(table)) + table)
        self.foot = 0
        self.ids: list[int | None] = []
        self.n: list[int] = []
        self.at: list[int] = []
        self.marks: list[bytes] = []

    def add(self, doc_id: int | None, n: int, bits: bytes, marks: bytes) -> None:
        self.ids.append(doc_id)
        self.n.append(n)
        self.at.append(self.size)
        self.marks.append(marks)
        self.size += self.out.write(bits)
        self.foot += 25 + len(marks)

    def close(self) -> tuple[int, int, str, int, int, int]:
        null = np.packbits([x is None for x in self.ids]).tobytes()
        foot = b"".join([np.array([x or 0 for x in self.ids], "<i8").tobytes(), np.array(self.n, "<i8").tobytes(), np.array(self.at, "<i8").tobytes(), b"".join(self.marks), null])
        self.out.write(foot + struct.pack("<QQ", len(self.ids), self.size) + MAGIC)
        self.out.close()
        return self.rid, self.part, self.path, len(self.ids), sum(self.n), self.size + len(foot) + 24


_FILES_DDL = "rid int, part int, path string, n_docs long, n_tokens long, n_bytes long"
_FILES = pa.schema([("rid", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])


def _write(folder: str, code, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_, done = None, []
    for batch in batches:
        for rid, doc, n, bits, marks in zip(*(batch.column(c).to_pylist() for c in ("rid", "doc_id", "n", "bits", "marks"))):
            if open_ is None or open_.rid != rid or open_.size + open_.foot >= most:
                part = open_.part + 1 if open_ and open_.rid == rid else 0
                done += [open_.close()] if open_ else []
                open_ = Writer(folder, rid, part, code.value)
            open_.add(doc, n, bits, marks)
    done += [open_.close()] if open_ else []
    yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], f.type) for k, f in enumerate(_FILES)], schema=_FILES)


def read_file(path: str, most: int = READ_IDS) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc ids, numbers of ids, all ids end to end) of the documents of one file in order, about most ids at a time; a longer document comes alone.

    The foot is read first; of the bits only those of the documents at hand, and of those some blocks at a time.
    """
    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_file(at) as f:
        size = f.size()
        head, tail = f.read_at(16, 0), f.read_at(24, max(0, size - 24))
        if head[:8] != MAGIC or tail[-8:] != MAGIC:
            raise ValueError(f"{path}: not a whole file of ids")
        symbols, packed = struct.unpack_from("<II", head, 8)
        lengths = np.frombuffer(zlib.decompress(f.read_at(packed, 16)), np.uint8, symbols)
        docs, foot = struct.unpack_from("<QQ", tail)
        data = f.read_at(size - 24 - foot, foot)
        ids, n, start = (np.frombuffer(data, "<i8", docs, 8 * docs * k) for k in range(3))
        blocks = (n + BLOCK - 1) // BLOCK
        marks = np.frombuffer(data, "<u8", int(blocks.sum()), 24 * docs).astype(np.int64)
        null = np.unpackbits(np.frombuffer(data, np.uint8, (docs + 7) // 8, 24 * docs + 8 * len(marks)))[:docs]
        sizes = np.full(len(marks), BLOCK, np.int64)
        some = blocks > 0
        sizes[(np.cumsum(blocks) - 1)[some]] = (n - (blocks - 1) * BLOCK)[some]
        table, step = decode_table(lengths), 1 << 13
        offsets, first = marks + 8 * np.repeat(start, blocks), np.concatenate([[0], np.cumsum(blocks)])
        ends, a = np.cumsum(n), 0
        while a < docs:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
            parts = [np.zeros(0, np.uint32)]
            for k in range(int(first[a]), int(first[b]), step):
                stop = min(k + step, int(first[b]))
                low, high = int(offsets[k]) // 8, int(offsets[stop]) // 8 + 8 if stop < len(offsets) else foot
                parts.append(get(np.frombuffer(f.read_at(min(high, foot) - low, low), np.uint8), offsets[k:stop] - 8 * low, sizes[k:stop], table))
            yield [None if x else int(i) for i, x in zip(ids[a:b], null[a:b])], n[a:b], np.concatenate(parts)
            a = b


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            for ids, n, tokens in read_file(path):
                ends = np.cumsum(n)
                tokens = tokens.astype("<u4")
                crc = [zlib.crc32(tokens[a:b]) for a, b in zip((ends - n).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start + ends - n), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                start += int(n.sum())


def write_ids(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the ids of all texts, each with end_id at its end, into files in ascending order of id; returns (rid, part, path, n_docs, n_tokens, n_bytes), a row for each file.

    Files follow one another by rid, then part. Null ids come last, null texts are empty; the order of rows with one id isn't defined. Ranges of
    ids hold about RANGE_IDS token ids or fewer, and a file is closed once it has file_bytes, so neither grows with the table. Other columns aren't
    read. An empty table writes no file. A file whose task failed isn't in the result.
    """
    spark = docs.sparkSession
    ship(spark)
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col), F.monotonically_increasing_id()).alias("tie"), F.col(text_col).alias("text"))  # copies of one id differ in tie, so that they too share ranges
    kind = encoder(path).type.str
    ids = stash(rows.mapInArrow(lambda b: _tokenize(path, end_id, b), _IDS_DDL), "ids")
    counted = ids.select(F.explode(F.arrays_zip("id", "times")).alias("c")).groupBy("c.id").agg(F.sum("c.times").alias("n")).collect()  # at most a row for each id of the vocabulary
    counts = np.zeros(max((r["id"] for r in counted), default=0) + 1, np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    rows = ids.where("n IS NOT NULL")
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(int(counts.sum()) / RANGE_IDS))
    cuts = [k / shards for k in range(1, shards)] or [0.5]
    bounds = rows.select(F.percentile_approx(F.coalesce("doc_id", F.lit((1 << 63) - 1)), F.array(*map(F.lit, cuts)), F.lit(max(10_000, 20 * shards)))).first()[0] or []
    edges = spark.sparkContext.broadcast(np.array(bounds[: shards - 1], np.int64))  # a number for each range
    code = spark.sparkContext.broadcast(code_lengths(counts))
    coded = rows.drop("id", "times").mapInArrow(lambda b: _encode(kind, code, edges, b), _CODED_DDL)
    ordered = coded.repartitionById(shards, F.col("rid")).sortWithinPartitions("rid", F.col("doc_id").asc_nulls_last(), F.shiftrightunsigned("tie", 1), "tie")
    files = stash(ordered.mapInArrow(lambda b: _write(folder, code, file_bytes, b), _FILES_DDL), "id-files")
    unstash(ids)
    return files


def read_ids(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the files; start counts the ids of all documents before it."""
    spark, start, rows = files.sparkSession, 0, []
    for r in files.orderBy("rid", "part").collect():  # a row for each file
        rows.append((r["path"], start))
        start += r["n_tokens"]
    listed = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))
    return listed.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, **options) -> DataFrame:
    """Writes the files into the shared folder and reads them back; see write_ids() and read_ids()."""
    return read_ids(write_ids(docs, shared_path(docs.sparkSession, "token-ids"), **options))
