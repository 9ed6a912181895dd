"""Best-fit packing of token pieces by length patterns fitted with non-negative least squares.

Texts are tokenised whole, cut into pieces of at most ``size`` tokens, and only (key, length, checksum) rows go on.
The driver sees one histogram of at most ``size`` counts. Patterns of up to three documents that fill a sequence are
enumerated over length classes, non-negative least squares fits their repeat counts to the histogram, the counts are
rounded down and carried out on exact lengths (the last document of a pattern is the best fit for what is left), and
the residual counts are packed by best fit in decreasing length. Everything there works on counts, so it takes the
same time for any number of documents. Each piece then finds its slot by its rank among the pieces of its length;
ranks are counted within salted groups, so a very common length is not ordered in one task.

Cases: a null or empty text is the single end-of-document token; repeated rows are packed as often as they occur; a
null doc_id is carried; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

SIZE = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
#: Distinct words a Python worker remembers at once.
CACHE_WORDS = 600_000
CLASSES = 256
GROUPS = 65_536


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _chars(prefix: str, below: int = 0x180) -> str:
    return "".join(re.escape(chr(c)) for c in range(below) if unicodedata.category(chr(c)).startswith(prefix))


class Encoder:
    """Token ids of whole texts. Words of Latin texts are looked up once and remembered; other texts, and those that
    may hold special tokens, go through the tokenizer as they are."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {}
        self.cache_words = cache_words
        letters, numbers, space = _chars("L"), _chars("N"), "\\t\\n\\x0b\\f\\r \\x85\\xa0"
        self.plain = re.compile("[\u0000-\u001b -įı-ſ‐-‧€]*")
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")

    def _learn(self, new: list[str]) -> None:
        # Without offsets, and a few hundred words at a time: both take the tokenizer less time for a word.
        for k in range(0, len(new), 512):
            part = new[k:k + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part):
                raw, stops = ids.tobytes(), (stops * 4).tolist()
                self.cache.update((w, raw[a:b]) for w, a, b in zip(part, [0, *stops], stops))
            else:
                for w in part:
                    self.cache[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out: list = [None] * len(texts)
        split = {}
        for i, text in enumerate(texts):
            if "<|" not in text and self.plain.fullmatch(text):
                split[i] = self.words.findall(text.lower())
            else:
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.cache) > self.cache_words:
            self.cache.clear()
        # set.difference(dict) looks up the few words of the batch; a set minus a view would go through the whole cache.
        new = set().union(*split.values()).difference(self.cache)
        if new:
            self._learn(list(new))
        get = self.cache.__getitem__
        for i, w in split.items():
            out[i] = b"".join(map(get, w))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_PIECES = "doc_id long, key long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """One narrow row per piece of every document."""
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                rows: list[tuple] = []
                ids = enc.encode([x or "" for x in part.column(2).to_pylist()])
                for doc, key, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), ids):
                    raw += end
                    for n, a in enumerate(range(0, len(raw), 4 * size)):
                        one = raw[a:a + 4 * size]
                        rows.append((doc, key, n, a // 4, len(one) // 4, zlib.crc32(one)))
                cols = list(zip(*rows))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                                 ["doc_id", "key", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(run, _PIECES)


def patterns(classes: int) -> np.ndarray:
    """Up to three class sizes (0: none) that add up to a whole sequence, largest first."""
    return np.array([(a, b, classes - a - b) for a in range(classes, 0, -1) for b in range(min(a, classes - a), -1, -1)
                     if classes - a - b <= b and (b or a == classes)])


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Least squares with x >= 0 by an active set; a column joins while it lowers the residual. After ``rounds`` the fit so
    far is taken: what it leaves over is packed as residual like the rest."""
    x, use = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    scale = max(1.0, float(np.abs(b).max()))
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[use] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= 1e-9 * scale:
            break
        use[j] = True
        while True:
            at = np.flatnonzero(use)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            bad = z <= 0
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.where(bad, x[at] / (x[at] - z), np.inf)
            step = float(np.nan_to_num(step, nan=0.0, posinf=np.inf).min())
            x[at] += min(1.0, step) * (z - x[at])
            drop = at[(x[at] <= 1e-12 * scale) | (bad & (step == 0))]
            x[drop] = 0
            use[drop] = False
            if not use.any():
                break
    return x


def plan(counts: np.ndarray, size: int = SIZE, classes: int = CLASSES) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, number of such sequences) that use up counts[length], length 1..size."""
    left = counts.astype(np.int64).copy()
    width = -(-size // classes)
    n_classes = size // width
    hist = np.zeros(n_classes)
    for length in np.flatnonzero(left):
        hist[min(n_classes, -(-length // width)) - 1] += left[length]
    shapes = patterns(n_classes)
    matrix = np.zeros((n_classes, len(shapes)))
    for k in range(3):
        some = shapes[:, k] > 0
        np.add.at(matrix, (shapes[some, k] - 1, np.flatnonzero(some)), 1)
    repeats = np.floor(nnls(matrix, hist) + 1e-9).astype(np.int64)
    done: list[tuple[tuple[int, ...], int]] = []

    def best(limit: int, least: int = 1) -> int:
        """The largest length there is up to limit; 0 if none."""
        at = np.flatnonzero(left[least:limit + 1])
        return int(at[-1]) + least if len(at) else 0

    for j in np.argsort(-shapes[:, 0] * 10_000 - shapes[:, 1], kind="stable"):
        todo = int(repeats[j])
        while todo > 0:
            one: list[int] = []
            last = np.flatnonzero(shapes[j])[-1]
            for k in range(last + 1):
                top = int(shapes[j, k]) * width
                # The last document may be longer than its class where the others leave room.
                length = best(size - sum(one) if k == last else top, top - width + 1)
                if not length:
                    break
                one.append(length)
                left[length] -= 1
            for length in one:
                left[length] += 1
            if len(one) <= last:
                break
            need = {x: one.count(x) for x in one}
            n = min(todo, *(int(left[x]) // c for x, c in need.items()))
            for x, c in need.items():
                left[x] -= c * n
            done.append((tuple(one), n))
            todo -= n
    # Best fit, longest first, over groups of equal sequences; those of the patterns are open as well.
    room: dict[int, list] = {}
    free = np.zeros(size + 1, bool)

    def put(lengths: tuple[int, ...], n: int) -> None:
        r = size - sum(lengths)
        room.setdefault(r, []).append((lengths, n))
        free[r] = True

    for lengths, n in done:
        put(lengths, n)
    for length in range(size, 0, -1):
        n = int(left[length])
        while n:
            at = np.flatnonzero(free[length:])
            if not len(at):
                each = size // length
                if n // each:
                    put((length,) * each, n // each)
                if n % each:
                    put((length,) * (n % each), 1)
                break
            r = int(at[0]) + length
            lengths, m = room[r].pop()
            if not room[r]:
                free[r] = False
            fit = min(r // length, n)
            k = min(m, n // fit)
            if m > k:
                put(lengths, m - k)
            put(lengths + (length,) * fit, k)
            n -= fit * k
    return [(lengths, n) for group in room.values() for lengths, n in group]


def slots(made: list[tuple[tuple[int, ...], int]], size: int = SIZE) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), ordered by length and rank."""
    rows, sequence, used = [], 0, np.zeros(size + 1, np.int64)
    for lengths, n in made:
        offset = 0
        for length in lengths:
            rows.append((length, int(used[length]), sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


_PACKED = _PIECES.replace("length int", "length long").replace("key long, ", "") + ", sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    """Every piece with its sequence and its place there."""
    rows = C.materialize(pieces(docs, tokenizer, size), "pieces")
    counts = np.zeros(size + 1, np.int64)
    for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r.length] = r.n
    table = slots(plan(counts, size), size)
    # Salted groups: a bounded number of them, of a few hundred rows on small inputs.
    each = max(256, -(-int(counts.sum()) // GROUPS))
    salts = np.maximum(1, -(-counts // each))
    salt = F.pmod(F.xxhash64("key", "piece"), F.element_at(F.array(*[F.lit(int(x)) for x in salts]), F.col("length") + 1))
    salted = rows.withColumn("salt", salt.cast("long"))
    groups = sorted((r.length, r.salt, r.n) for r in
                    salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).collect())
    base, so_far = [], {}
    for length, s, n in groups:
        base.append((length, s, so_far.get(length, 0)))
        so_far[length] = so_far.get(length, 0) + n
    base_of = np.array(base, dtype=np.int64).reshape(-1, 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group_key = base_of[:, 0] << 32 | base_of[:, 1]
        slot_key = table[:, 0] << 44 | table[:, 1]
        for b in batches:
            length, s, rn = (b.column(c).to_numpy().astype(np.int64) for c in (3, 5, 6))
            rank = base_of[np.searchsorted(group_key, length << 32 | s), 2] + rn - 1
            at = table[np.searchsorted(slot_key, length << 44 | rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(length), b.column(4),
                 pa.array(at[:, 2] + rank - at[:, 1]), pa.array(at[:, 3])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    order = Window.partitionBy("length", "salt").orderBy("key", "piece")
    return (salted.withColumn("rn", F.row_number().over(order).cast("long"))
            .select("doc_id", "piece", "start", "length", "ids_crc32", "salt", "rn").mapInArrow(run, _PACKED))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.documents(spark, sf_dir))


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
SQL: dict[str, str] = {}
