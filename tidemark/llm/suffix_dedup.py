"""Removal of repeated byte strings: prefix doubling over sampled positions.

Every 200-byte string is named by the smallest hash among its 64-byte substrings; the place of that substring is its
anchor. Equal strings have equal anchors at equal offsets, so only anchors take part in the first rounds, about one
position in seventy. Spark sorts position rank pairs:

1. (rank of the anchor's 64 bytes, rank of the whole stretch of strings that share the anchor). A position whose
   first rank is unique is dropped with all its strings; where the pair occurs again the stretch is past the threshold
   and all its bytes repeat.
2. For anchors that remain (64 bytes repeat, the stretch does not), pairs (rank of the anchor, rank of 200 bytes from
   a start), at every start of one representative of each stretch.

Ranks are 64-bit hashes, so a pair has 128 bits. Copies inside one task are ranked there and one of them goes on, and
round 1 is dealt by ranges of the pair, so a text in a third of all rows fills no task. In round 2 an anchor with few
stretches is ranked inside one task from the stretches' bytes; the strings of one with many are pairs of their own.

Cases: a null or short text has nothing to remove; repeated rows repeat each other; a null doc_id is carried; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .fingerprint_bytes import Ranges, mix, sliding_min

LENGTH = 200
GRAM = 64
#: Stretches of one anchor that are ranked in one task; above it every string is a pair of its own.
TOGETHER = 256
#: Bytes of a text worked on at once; a longer one is cut, its strings are not.
PIECE = 1 << 20
_POS = np.uint64((1 << 24) - 1)
_ROUND = "a long, f long, key long, s long, e long, kind int"
_NAMES = ["a", "f", "key", "s", "e", "kind"]


def _key():
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text").isNull(), F.col("text"))


ONE, KNOWN, COVER = 0, 1, 2


def stretches(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor rank, stretch rank, first start, last start) of the stretches of one text."""
    out = []
    width = length - gram + 1
    for at in range(0, max(0, len(data) - length + 1), PIECE):
        part = data[at:at + PIECE + length - 1]
        r = Ranges(part)
        grams = r.every(gram)
        # The smallest hash with its place; of equal ones the first.
        low = sliding_min((grams & ~_POS) | np.arange(len(grams), dtype=np.uint64), width)[:len(part) - length + 1]
        anchor = (low & _POS).astype(np.int64)
        s = np.r_[0, np.flatnonzero(np.diff(anchor)) + 1]
        e = np.r_[s[1:] - 1, len(anchor) - 1]
        a = anchor[s]
        shape = mix(((a - s).astype(np.uint64) << np.uint64(20)) | (e - s).astype(np.uint64))
        out.append((grams[a], mix(r.hash(s, e + length) ^ shape), s + at, e + at))
    if not out:
        none = np.zeros(0, np.uint64)
        return none, none, none.astype(np.int64), none.astype(np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _batch(a, f, key, s, e, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x).astype(np.int64)) for x in (a, f, key, s, e)]
                                      + [pa.array(np.asarray(kind).astype(np.int32))], _NAMES)


def merged(key: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of the ranges [s, e) of each key."""
    if not len(key):
        return key, s, e
    o = np.lexsort((s, key))
    key, s, e = key[o], s[o], e[o]
    # Ends as running maxima within a key: keys are numbered so that later ones start higher.
    n = np.cumsum(np.r_[0, key[1:] != key[:-1]])
    big = int(e.max()) + 1
    top = np.maximum.accumulate(e + n * big)
    new = np.r_[True, (s + n * big)[1:] > top[:-1]]
    at = np.flatnonzero(new)
    return key[at], s[at], top[np.r_[at[1:] - 1, len(top) - 1]] - n[at] * big


def _locally(a, f, key, s, e) -> pa.RecordBatch:
    """Pairs that repeat inside this task are covered here; one of each goes on, known to repeat."""
    o = np.lexsort((f, a))
    a, f, key, s, e = a[o], f[o], key[o], s[o], e[o]
    first = np.r_[True, (a[1:] != a[:-1]) | (f[1:] != f[:-1])]
    group = np.cumsum(first) - 1
    many = np.bincount(group)[group] > 1
    ck, cs, ce = merged(key[many], s[many], e[many])
    kind = np.where(many[first], KNOWN, ONE)
    zero = np.zeros(len(ck), np.int64)
    # Covers need no order; they are spread by the hash of their place.
    spread = mix(ck.astype(np.uint64) ^ cs.astype(np.uint64)).view(np.int64)
    return _batch(np.r_[a[first].view(np.int64), spread], np.r_[f[first].view(np.int64), zero], np.r_[key[first], ck],
                  np.r_[s[first], cs], np.r_[e[first], ce], np.r_[kind, np.full(len(ck), COVER)])


def _first_round(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for key, text in zip(b.column(0), b.column(1)):
                data = np.frombuffer(text.as_buffer() or b"", np.uint8) if text.is_valid else np.zeros(0, np.uint8)
                if len(data) < length:
                    continue
                a, f, s, e = stretches(data, length)
                held.append((a, f, np.full(len(a), key.as_py()), s, e + length))
                n += len(a)
                if n > 400_000:
                    yield _locally(*(np.concatenate(x) for x in zip(*held)))
                    held, n = [], 0
        if held:
            yield _locally(*(np.concatenate(x) for x in zip(*held)))

    return run


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range of pairs, sorted: covers of what repeats (kind COVER), and one row for each pair of an anchor
    that has several (KNOWN if the pair itself repeats, else ONE). Stretches of about CHUNK rows are in memory at a time;
    they end between pairs (of a pair there is one row for each task of the first round at most)."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < CHUNK:
            continue
        t = pa.Table.from_batches(held)
        a, f = t.column("a").to_numpy(), t.column("f").to_numpy()
        cut = int(np.argmax((a == a[-1]) & (f == f[-1])))  # where the last pair begins
        if cut:
            yield from _ranked_rows(t.slice(0, cut))
            held, n = t.slice(cut).to_batches(), n - cut
    if held:
        yield from _ranked_rows(pa.Table.from_batches(held))


CHUNK = 1_000_000


def _ranked_rows(t: pa.Table) -> Iterator[pa.RecordBatch]:
    a, f, key, s, e, kind = (t.column(c).to_numpy() for c in _NAMES)
    done = kind == COVER
    ck, cs, ce = key[done], s[done], e[done]
    a, f, key, s, e, kind = (x[~done] for x in (a, f, key, s, e, kind))
    if len(a):
        first = np.r_[True, (a[1:] != a[:-1]) | (f[1:] != f[:-1])]
        group = np.cumsum(first) - 1
        many = (np.bincount(group)[group] > 1) | (np.bincount(group, kind == KNOWN)[group] > 0)
        fresh = many & (kind != KNOWN)  # the known ones were covered where they were found
        ck, cs, ce = np.r_[ck, key[fresh]], np.r_[cs, s[fresh]], np.r_[ce, e[fresh]]
        own = np.flatnonzero(first)
        ga = a[own]
        several = np.r_[False, ga[1:] == ga[:-1]] | np.r_[ga[1:] == ga[:-1], False]
        several[0] = several[-1] = True  # the anchor may go on in the next range or stretch of rows
        own = own[several]
        yield _batch(a[own], f[own], key[own], s[own], e[own], np.where(many[own], KNOWN, ONE))
    ck, cs, ce = merged(ck, cs, ce)
    if len(ck):
        yield _batch(np.zeros(len(ck)), np.zeros(len(ck)), ck, cs, ce, np.full(len(ck), COVER))


def _strings(length: int):
    """Stretches with their bytes (cold) or as one pair for each string (hot): a, f, key, s, e, kind, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = []
            for key, text, todo in zip(b.column(0), b.column(1), b.column(2)):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                key, todo = key.as_py(), todo.as_py()
                cold = [x for x in todo if not x["hot"]]
                if cold:
                    raw = text.as_py()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[c] for x in cold], pa.int64()) for c in ("a", "f")]
                        + [pa.array([key] * len(cold), pa.int64())]
                        + [pa.array([x[c] for x in cold], pa.int64()) for c in ("s", "e")]
                        + [pa.array([x["kind"] for x in cold], pa.int32()),
                           pa.array([raw[x["s"]:x["e"]] for x in cold], pa.binary())], [*_NAMES, "bytes"])
                hot = [x for x in todo if x["hot"]]
                if hot:
                    low = min(x["s"] for x in hot)
                    r = Ranges(data[low:max(x["e"] for x in hot)])
                    for x in hot:
                        at = np.arange(x["s"], x["e"] - length + 1)
                        w = r.hash(at - low, at - low + length)
                        held.append((np.full(len(at), x["a"]).view(np.uint64), w, np.full(len(at), key), at, at + length))
            if held:
                one = _locally(*(np.concatenate(x) for x in zip(*held)))
                yield pa.RecordBatch.from_arrays([*one.columns, pa.nulls(one.num_rows, pa.binary())], [*_NAMES, "bytes"])

    return run


def _together(length: int):
    """Cold anchors, rows sorted by anchor: strings that occur in two of its stretches."""

    def group(rows: list[tuple]) -> tuple:
        w, key, at, own = [], [], [], []
        for i, (raw, k, s, e, kind) in enumerate(rows):
            h = Ranges(np.frombuffer(raw, np.uint8)).every(length)
            w.append(h)
            key.append(np.full(len(h), k))
            at.append(np.arange(s, s + len(h)))
            own.append(np.full(len(h), kind == ONE))
        w, key, at, own = map(np.concatenate, (w, key, at, own))
        _, inverse, n = np.unique(w, return_inverse=True, return_counts=True)
        hit = (n[inverse] > 1) & own
        return key[hit], at[hit], at[hit] + length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, last, out, size = [], None, [], 0
        for b in batches:
            a = b.column(0).to_pylist()
            for anchor, *row in zip(a, *(b.column(c).to_pylist() for c in (1, 2, 3, 4, 5))):
                if anchor != last:
                    if len(rows) > 1:
                        out.append(group(rows))
                        size += len(out[-1][0])
                    rows, last = [], anchor
                    if size > 100_000:
                        k, s, e = merged(*(np.concatenate(x) for x in zip(*out)))
                        yield _batch(0 * k, 0 * k, k, s, e, np.full(len(k), COVER))
                        out, size = [], 0
                rows.append(row)
        if len(rows) > 1:
            out.append(group(rows))
        if out:
            k, s, e = merged(*(np.concatenate(x) for x in zip(*out)))
            yield _batch(0 * k, 0 * k, k, s, e, np.full(len(k), COVER))

    return run


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.repartitionByRange("a", "f").sortWithinPartitions("a", "f").mapInArrow(_rank, _ROUND)


def _tidy(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished rounds."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, s, e): bytes of each distinct row that a repeated string of ``length`` bytes covers; ranges may overlap."""
    spark = docs.sparkSession
    texts = docs.select(_key().alias("key"), F.col("text").cast("binary").alias("text"))
    one = C.materialize(_ranked(texts.mapInArrow(_first_round(length), _ROUND)), "round1")
    _tidy(spark)
    left = one.where(F.col("kind") != COVER)
    hot = left.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TOGETHER).select("a", F.lit(True).alias("hot"))
    todo = (C.sized_join(left, C.materialize(hot, "hot"), "a", "left").groupBy("key").agg(F.collect_set(F.struct(
        "a", "f", "s", "e", "kind", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("todo")))
    # Equal rows have one key and need their bytes once each; what they share is in round 1 already.
    named = texts.join(todo, "key").select("key", "text", "todo")
    two = C.materialize(named.mapInArrow(_strings(length), _ROUND + ", bytes binary"), "round2")
    _tidy(spark)
    cold = (two.where(F.col("bytes").isNotNull()).select("a", "bytes", "key", "s", "e", "kind").distinct()
            .repartition("a").sortWithinPartitions("a").mapInArrow(_together(length), _ROUND))
    pairs = _ranked(two.where(F.col("bytes").isNull()).select(*_NAMES).distinct())
    found = cold.union(pairs).union(one).where(F.col("kind") == COVER).select("key", "s", "e")
    return C.materialize(found, "repeats")


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for raw, spans in zip(b.column(1), b.column(2)):
            data = raw.as_buffer() if raw.is_valid else b""
            data = memoryview(data) if data is not None else memoryview(b"")
            h, at, gone, n = hashlib.sha256(), 0, 0, 0
            if spans.is_valid:
                flat = spans.values
                s, e = flat.field("s").to_numpy(), flat.field("e").to_numpy()
                _, s, e = merged(np.zeros(len(s), np.int64), s, e)
                for x, y in zip(s.tolist(), e.tolist()):
                    h.update(data[at:x])
                    at, gone, n = y, gone + y - x, n + 1
            h.update(data[at:])
            rows.append((len(data), gone, n, h.hexdigest()))
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                                         ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Digest columns of every row after the removal."""
    spans = repeats(docs, length).groupBy("key").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    d = docs.select("doc_id", F.col("text").cast("binary").alias("text"), _key().alias("key"))
    return d.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(_cut, _OUT)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(C.documents(spark, sf_dir))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
SQL: dict[str, str] = {}
