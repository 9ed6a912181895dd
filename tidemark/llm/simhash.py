"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints (64 majority bits of the XXH64 hashes of 3-word shingles) link at ``radius`` or fewer differing bits.
Bits are grouped into partitions so that correlated bits stand together; a dynamic program gives each partition its
own threshold, the thresholds plus one adding up to radius plus one, so that every link is within the threshold of
at least one partition. A threshold t is probed by the keys that mask any t bits of the partition. Distinct
fingerprints that share a key are verified; a key with more than ``bucket`` fingerprints is refined by masks over the
bits that it leaves open (radius + 1 blocks, of which a linked pair agrees on one), until every bucket is small, so
that no task holds a large group and no link is lost.

Cases: a null or blank text has fingerprint zero and links like any other; a text of one or two words is one shingle;
a null doc_id gets a fingerprint but never names a component; repeated rows are copies of each other; an empty table
gives an empty result; other columns are ignored or, by :func:`keep_one`, carried through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import connected_components

BITS = 64
RADIUS = 3
BUCKET = 1024
SEED = 42


def fingerprint(text: bytes | None) -> int:
    """The signed 64-bit SimHash of one UTF-8 text."""
    import xxhash

    w = (text or b"").lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(w, w[1:], w[2:])) if len(w) >= 3 else [b" ".join(w)]
    h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = pa.array([fingerprint(x.as_py()) for x in b.column(2)], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp], ["doc_id", "key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, key, fp) of every row, from whole texts."""
    d = docs.select("doc_id", C.row_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("text").cast("binary"))
    return d.mapInArrow(_fingerprints, f"doc_id long, key {C.KEY}, fp long")


def _cooccurrence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS), dtype=np.int64)
    for b in batches:
        v = b.column(0).to_numpy(zero_copy_only=False).astype("<i8")
        for k in range(0, len(v), 65536):
            x = np.unpackbits(v[k:k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (x.T @ x).astype(np.int64)
    i, j = np.triu_indices(BITS)
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                      pa.array(total[i, j])], ["i", "j", "n"])


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set: 2,080 sums, whatever the input."""
    n = distinct.count()
    both = np.zeros((BITS, BITS))
    rows = (distinct.select("fp").mapInArrow(_cooccurrence, "i int, j int, n long")
            .groupBy("i", "j").agg(F.sum("n").alias("n")).collect())
    for r in rows:
        both[r.i, r.j] = both[r.j, r.i] = r.n
    return n, both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of near-equal width; each starts at the most correlated free bit and takes its closest bits."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        width = (BITS - sum(map(len, groups))) // (parts - k)
        rest = sorted(free)
        group = [max(rest, key=lambda b: (corr[b, rest].sum(), -b))]
        while len(group) < width:
            group.append(max((b for b in rest if b not in group), key=lambda b: (corr[b, group].sum(), -b)))
        groups.append(sorted(group))
        free -= set(group)
    return groups


#: Fingerprints from which candidates are estimated; they decide what is probed, never what is found.
SAMPLE = 2048


def sampled_near(sample: np.ndarray, group: list[int], radius: int) -> np.ndarray:
    """The share of pairs of a sample that differ in at most 0, 1 ... radius bits of a group: projections of whole
    fingerprints, so that bits which go together count as they do."""
    x = sample.view(np.uint64) & np.uint64(sum(1 << b for b in group))
    found = np.zeros(65, np.int64)
    for s in range(0, len(x), 256):
        found += np.bincount(np.bitwise_count(x[s:s + 256, None] ^ x[None, :]).ravel(), minlength=65)
    found[0] -= len(x)  # each with itself
    return np.cumsum(found)[:radius + 1] / max(1, len(x) * (len(x) - 1))


def _near(q: np.ndarray, t: int) -> float:
    """Chance that two fingerprints differ in at most t of the bits that each agree with chance q."""
    d = np.zeros(t + 2)
    d[0] = 1
    for x in q:
        d[1:] = d[1:] * x + d[:-1] * (1 - x)
        d[0] *= x
        d[-1] = 0
    return float(d[:t + 1].sum())


def allocate(n: int, both: np.ndarray, radius: int = RADIUS, sample: np.ndarray = np.zeros(0, "<i8")) -> list[tuple[list[int], int]]:
    """The partitions to probe with their thresholds: for each number of partitions a dynamic program over
    estimated cost (probe rows and candidate pairs), then the cheapest. Candidates are counted on the sample's projections;
    what is too rare to show there is estimated from the bits' frequencies, as if they were independent."""
    p = np.diag(both) / max(n, 1)
    q = p * p + (1 - p) ** 2
    best: tuple[float, list] = (inf, [])
    for parts in range(1, radius + 3):
        groups = group_bits(n, both, parts)
        table = {0: (0.0, [])}
        for g in groups:
            after: dict = {}
            share = sampled_near(sample, g, radius)
            for used, (cost, chosen) in table.items():
                for t in range(-1, radius - used + 1):
                    rows = n * comb(len(g), t) if t >= 0 else 0
                    pairs = n * n / 2 * max(share[t], _near(q[g], t)) * max(1, comb(len(g), max(t, 0))) if t >= 0 else 0
                    x = cost + rows + 0.05 * pairs
                    if used + t + 1 not in after or x < after[used + t + 1][0]:
                        after[used + t + 1] = (x, [*chosen, (g, t)])
            table = after
        if radius + 1 in table and table[radius + 1][0] < best[0]:
            best = table[radius + 1]
    return [(g, t) for g, t in best[1] if t >= 0]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def probe_masks(plan: list[tuple[list[int], int]]) -> list[int]:
    return [_signed(sum(1 << b for b in g if b not in off)) for g, t in plan for off in combinations(g, t)]


def finer_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """The mask with each of radius + 1 blocks of its open bits added."""
    open_bits = [b for b in range(BITS) if not mask >> b & 1]
    return [_signed((mask | sum(1 << b for b in open_bits[k::radius + 1])) & ((1 << BITS) - 1))
            for k in range(radius + 1) if open_bits[k::radius + 1]]


def _differ(x: np.ndarray, y) -> np.ndarray:
    """Differing bits; numpy counts those of the absolute value of signed numbers, hence the view."""
    return np.bitwise_count((x ^ y).view(np.uint64))


def _links(radius: int):
    def spanning(x: np.ndarray) -> tuple[list[int], list[int]]:
        """Edges that join what is linked among x, without all pairs: a breadth-first forest."""
        left, a, b = np.ones(len(x), bool), [], []
        for s in range(len(x)):
            if not left[s]:
                continue
            left[s], todo = False, [s]
            while todo:
                u = todo.pop()
                near = np.flatnonzero(left & (_differ(x, x[u]) <= radius))
                left[near] = False
                todo += near.tolist()
                a += [int(x[u])] * len(near)
                b += x[near].tolist()
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (mask, key); the last bucket of a batch waits for the next."""
        kept = [np.zeros(0, "<i8")] * 3

        def edges(m, k, f, last):
            starts = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (k[1:] != k[:-1])]) if len(m) else np.zeros(0, int)
            stop = len(m) if last else (starts[-1] if len(starts) else 0)
            ends = np.r_[starts[1:], len(m)]
            size = ends - starts
            run_of = np.repeat(np.arange(len(starts)), size)
            small = (size <= 16) & (ends <= stop)
            a, b = [], []
            for o in range(1, 16):
                i = np.flatnonzero(small[run_of[:-o]] & (run_of[:-o] == run_of[o:])) if len(m) > o else np.zeros(0, int)
                if not len(i):
                    break
                i = i[_differ(f[i], f[i + o]) <= radius]
                a += f[i].tolist()
                b += f[i + o].tolist()
            for s, e in zip(starts[(size > 16) & (ends <= stop)], ends[(size > 16) & (ends <= stop)]):
                x, y = spanning(np.unique(f[s:e]))
                a += x
                b += y
            return a, b, stop

        for batch in batches:
            now = [np.r_[old, batch.column(c).to_numpy(zero_copy_only=False)] for c, old in enumerate(kept)]
            a, b, stop = edges(*now, False)
            kept = [x[stop:] for x in now]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        a, b, _ = edges(*kept, True)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def linked_pairs(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that join exactly what links at ``radius`` or fewer bits join."""
    spark = distinct.sparkSession
    n, both = bit_statistics(distinct)
    some = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    sample = np.array([r.fp for r in some], dtype="<i8")
    masks = probe_masks(allocate(n, both, radius, sample)) if n else [0]
    keyed = lambda df: df.withColumn("k", F.col("fp").bitwiseAND(F.col("m")))
    work = keyed(distinct.select(F.explode(F.array(*[F.lit(m) for m in masks])).alias("m"), "fp"))
    found = None
    while True:
        hot = work.groupBy("m", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("m", "k")
        hot = C.materialize(hot, "hot")
        wide = [r.m for r in hot.select("m").distinct().collect()]  # a few per level: masks, not fingerprints
        cold = work.join(hot, ["m", "k"], "left_anti") if wide else work
        edges = (cold.select("m", "k", "fp").repartition("m", "k").sortWithinPartitions("m", "k", "fp")
                 .mapInArrow(_links(radius), "a long, b long"))
        found = edges if found is None else found.union(edges)
        if not wide:
            return found
        finer = spark.createDataFrame([(m, x) for m in wide for x in finer_masks(m, radius)], "m long, finer long")
        work = work.join(hot, ["m", "k"], "left_semi")
        work = C.materialize(keyed(work.join(F.broadcast(finer), "m").select(F.col("finer").alias("m"), "fp").distinct()),
                             "finer")


def duplicates(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, key, fp, component_id) of every row."""
    rows = C.materialize(fingerprints(docs), "fingerprints")
    distinct = C.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = connected_components(linked_pairs(distinct, radius, bucket))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(rooted.join(ids, "root").select("fp", "component_id"), "fp").select(
        "doc_id", "key", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """docs with one document of each component: that with the smallest doc_id; all columns unchanged.

    Where all ids of a component are null, one row of each of its fingerprints stays. Of repeated rows one stays.
    """
    found = C.materialize(duplicates(docs, radius, bucket), "duplicates")
    nameless = found.where("component_id IS NULL").groupBy("fp").agg(F.min("key").alias("key")).select("key")
    stay = (found.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id")
            .agg(F.min("key").alias("key")).select("key").union(nameless))
    key, = C.free(docs, "__key")
    gone = C.materialize(found.select("key").distinct().join(stay, "key", "left_anti").select(F.col("key").alias(key)), "gone")
    out = C.sized_join(docs.withColumn(key, C.row_key(F.col("doc_id"), F.col("text"))), gone, key, "left_anti")
    # Rows that repeat as a whole.
    repeated = found.groupBy(F.col("key").alias(key)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    return C.once(out, C.materialize(repeated, "repeated"), key).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(C.documents(spark, sf_dir)).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash": op8_simhash}
SQL: dict[str, str] = {}
