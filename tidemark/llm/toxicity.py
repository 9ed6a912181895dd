"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the mean of hashed vectors of the word and of its first 3, 4 and 5 characters, so that inflected
forms share evidence. Filters of widths 1 to 3 slide over the whole text, each keeps its maximum, and a logistic
layer reads the maxima. A fifth of each class by a hash (one row at least) is kept out of the training, unless it is all
there is of the class; Platt scaling on it turns the output into a chance, and thresholds for verdicts are set for each
language: that of the language's own rows and that of all rows, weighed by n and ``Policy.prior`` (scores never see the
language).

Every labelled row that may be learned from is used, with its whole text. Rows are dealt by a hash into parts of about
twice ``Policy.fit_chars`` characters, which are tokenised once and written batch by batch. In each epoch one task per part and start passes
over its part, and Spark merges what the parts made of the network; document counts of the buckets are summed over all
parts, and all held rows count in the choice of the start, the scaling and the thresholds, with their outputs rounded to
``1 / BINS``. The driver sees the networks, one count per bucket and class and one per rounded output and language, and no
texts. Scoring is a map over the whole table and whole texts.

Cases: null and empty texts have no words and get the score of the bias alone; null labels and ids are never learned
from; repeated rows get equal scores; with labels of one class only, or none, every score is the share of toxic labels
(0 without labels); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

_WORDS = re.compile(r"\w+")
#: Outputs of held rows are counted in steps of 1 / BINS, up to LIMIT on either side.
BINS, LIMIT = 256, 64
#: Numbers of a network that are merged as one row.
BLOCK = 16_384


@dataclass(frozen=True)
class Policy:
    fit_chars: int = 20_000_000
    prior: float = 30.0
    starts: int = 4
    buckets: int = 1 << 15
    dim: int = 8
    filters: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    epochs: int = 8
    batch: int = 32
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 5
    cache_words: int = 400_000


def features(word: str, buckets: int) -> tuple[int, int, int, int]:
    """Hash buckets of the word and of its first 3, 4 and 5 characters."""
    h = lambda s: zlib.crc32(s.encode("utf-8", "surrogatepass")) % buckets
    return h("w " + word), h("3 " + word[:3]), h("4 " + word[:4]), h("5 " + word[:5])


@dataclass
class Model:
    policy: Policy
    emb: np.ndarray = None
    conv: list = field(default_factory=list)
    bias: list = field(default_factory=list)
    out: np.ndarray = None
    out_bias: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    constant: float | None = None
    thresholds: dict = field(default_factory=dict)

    def pooled(self, x: np.ndarray, starts: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, list]:
        """Filter maxima per document. x: word vectors of documents one after the other, each followed by a zero vector
        for every place by which the widest filter overhangs (gap); starts: where each begins. A window that starts in a
        gap is empty, whatever follows the gap."""
        cols, z_of = [], []
        for k, w in enumerate(self.policy.widths):
            z = np.zeros((len(x), self.policy.filters), np.float32)
            for j in range(w):
                part = x @ self.conv[k][j]
                z[:len(x) - j] += part[j:]
            z[gap] = 0
            z += self.bias[k]
            cols.append(np.maximum.reduceat(z, starts, axis=0))
            z_of.append(z)
        return np.concatenate(cols, axis=1), z_of

    def raw(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.out + self.out_bias

    def score(self, raw: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * raw.astype(np.float64) + b, -30, 30)))


def _layout(docs: list[np.ndarray], pad: int, overhang: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words one document after the other, where each begins, and which places are gaps."""
    gap = np.full(overhang, pad, np.int64)
    parts, starts, at = [], [], 0
    for d in docs:
        parts += [d, gap]
        starts.append(at)
        at += len(d) + overhang
    between = np.zeros(at, bool)
    ends = np.array([*starts[1:], at])
    for k in range(1, overhang + 1):
        between[ends - k] = True
    return np.concatenate(parts), np.array(starts), between


def _batch(texts: list[str], policy: Policy, seen: dict) -> dict:
    """Texts as arrays: the four buckets of each distinct word (the last is the gap), the words' places, where texts begin
    and how many words they have. seen: buckets of words met before."""
    here: dict[str, int] = {}
    docs = [np.array([here.setdefault(w, len(here)) for w in _WORDS.findall(t.lower())], np.int64) for t in texts]
    if len(seen) > policy.cache_words:
        seen.clear()
    for w in here:
        if w not in seen:
            seen[w] = struct.pack("<4I", *features(w, policy.buckets))
    feats = np.frombuffer(b"".join([*map(seen.__getitem__, here), struct.pack("<4I", *(policy.buckets,) * 4)]), "<u4").reshape(-1, 4).T
    ids, starts, _ = _layout(docs, len(here), max(policy.widths) - 1 or 1)
    narrow = lambda x, most: np.ascontiguousarray(x, np.min_scalar_type(most))
    return {"feats": narrow(feats, policy.buckets), "ids": narrow(ids, len(here)), "starts": starts.astype("<u4"), "sizes": np.array([len(d) for d in docs], "<u4")}


def _split(flat: np.ndarray, policy: Policy) -> tuple[np.ndarray, list, np.ndarray, np.ndarray]:
    """Views of a network's numbers: embeddings, filters by width, biases, output weights; the output's bias is last."""
    d, f, at = policy.dim, policy.filters, (policy.buckets + 1) * policy.dim
    emb, conv = flat[:at].reshape(-1, d), []
    for w in policy.widths:
        conv.append(flat[at:at + w * d * f].reshape(w, d, f))
        at += w * d * f
    n = f * len(policy.widths)
    return emb, conv, flat[at:at + n], flat[at + n:at + 2 * n]


def _first(leaning: np.ndarray, policy: Policy, seed: int) -> np.ndarray:
    """A random start."""
    rng, d, f, v = np.random.default_rng(seed), policy.dim, policy.filters, policy.buckets + 1
    n = f * len(policy.widths)
    flat = np.zeros(v * d + sum(policy.widths) * d * f + 2 * n + 1, np.float32)
    emb, conv, _, out = _split(flat, policy)
    emb[:] = rng.standard_normal((v, d)) * 0.05
    # The first dimension starts as how far each bucket's share of toxic documents is from its share of the others, in
    # standard errors: few labels then suffice to point the filters at words that tell the classes apart.
    emb[:, 0] = np.clip(leaning, -4, 4) * 0.1
    emb[-1] = 0
    for c in conv:
        c[:] = rng.standard_normal(c.shape) * 0.5
    out[:] = rng.standard_normal(n) * 0.3
    return flat


def _counts(batches: list[dict], policy: Policy) -> np.ndarray:
    """Documents of each class (rows) that hold each bucket; the last column counts all documents."""
    held = np.zeros((2, policy.buckets + 1))
    for b in batches:
        for s, n, y in zip(b["starts"].tolist(), b["sizes"].tolist(), b["y"].tolist()):
            held[int(y), np.unique(b["feats"][:, b["ids"][s:s + n]])] += 1
            held[int(y), -1] += 1
    return held


def _leaning(held: np.ndarray) -> np.ndarray:
    n = held[:, -1:]
    share = (held + 0.5) / (n + 1)
    both = (held.sum(axis=0) + 1) / (n.sum() + 2)
    return (share[1] - share[0]) / np.sqrt(both * (1 - both) * (1 / (n[0] + 1) + 1 / (n[1] + 1)))


def _vectors(emb: np.ndarray, feats: np.ndarray) -> np.ndarray:
    return (emb.take(feats[0], axis=0) + emb.take(feats[1], axis=0) + emb.take(feats[2], axis=0) + emb.take(feats[3], axis=0)) / 4


def _tops(b: dict, x: np.ndarray, conv: list, bias: np.ndarray, policy: Policy) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Filter maxima of each text, the places they come from, and whether a word gives them (else the gap does).
    x: vectors of the distinct words."""
    ids, f = b["ids"], policy.filters
    z = np.empty((f * len(policy.widths), len(ids)), np.float32)
    for k, w in enumerate(policy.widths):
        part = z[k * f:(k + 1) * f]
        for j in range(w):
            seen = (x @ conv[k][j]).T.copy()  # a filter's products in one row: places are then looked up in the cache
            if j:
                part[:, :len(ids) - j] += seen.take(ids[j:], axis=1)
            else:
                seen.take(ids, axis=1, out=part, mode="clip")
    place = np.zeros((len(b["starts"]), len(z)), np.int64)
    for i, (s, n) in enumerate(zip(b["starts"].tolist(), b["sizes"].tolist())):
        if n:
            z[:, s:s + n].argmax(axis=1, out=place[i])
        place[i] += s
    top = z[np.arange(len(z)), place]
    live = (top > 0) & (b["sizes"] > 0)[:, None]
    return np.where(live, top, 0) + bias, place, live


def _wide(b: dict) -> dict:
    """Indices in the width that numpy looks up by."""
    return b | {"feats": b["feats"].astype(np.int64), "ids": b["ids"].astype(np.int64)}


def _outputs(b: dict, flat: np.ndarray, policy: Policy) -> np.ndarray:
    b = _wide(b)
    emb, conv, bias, out = _split(flat, policy)
    top = _tops(b, _vectors(emb, b["feats"]), conv, bias, policy)[0]
    return np.maximum(top, 0) @ out + flat[-1]


def _epoch(flat: np.ndarray, batches: list[dict], policy: Policy, rng: np.random.Generator) -> np.ndarray:
    """One pass of Adam over the batches, in random order."""
    flat = flat.copy()
    emb, conv, bias, out = _split(flat, policy)
    d_, f_, rest = policy.dim, policy.filters, flat[emb.size:-1]
    first, second = np.zeros_like(emb), np.zeros_like(emb)
    m1, m2 = np.zeros_like(rest), np.zeros_like(rest)
    grad = np.zeros_like(flat)
    _, gconv, gbias, gout = _split(grad, policy)
    grest = grad[emb.size:-1]
    for step, n in enumerate(rng.permutation(len(batches)), 1):
        b = _wide(batches[n])
        x = _vectors(emb, b["feats"])
        top, place, live = _tops(b, x, conv, bias, policy)
        act = np.maximum(top, 0)
        p = 1 / (1 + np.exp(-np.clip(act @ out + flat[-1], -30, 30)))
        g = ((p - b["y"]) / len(p)).astype(np.float32)
        gout[:] = act.T @ g
        dtop = g[:, None] * out * (top > 0)
        gbias[:] = dtop.sum(axis=0)
        dtop *= live  # of an empty window only the bias learns
        words, flows = [], []
        for k, w in enumerate(policy.widths):
            flow, at = dtop[:, k * f_:(k + 1) * f_], place[:, k * f_:(k + 1) * f_]
            for j in range(w):
                word = b["ids"][np.minimum(at + j, len(b["ids"]) - 1)]
                gconv[k][j] = np.einsum("bf,bfd->df", flow, x[word])
                words.append(word.ravel())
                flows.append((flow[:, :, None] * conv[k][j].T).reshape(-1, d_))
        word, spot = np.unique(np.concatenate(words), return_inverse=True)
        gw = _sums(spot, np.concatenate(flows), len(word)) / 4
        rows, spot = np.unique(b["feats"][:, word].ravel(), return_inverse=True)
        gr = _sums(spot, np.tile(gw, (4, 1)), len(rows))
        use = (rows < policy.buckets) & np.abs(gr).any(axis=1)  # the gap stays zero
        rows, gr = rows[use], gr[use] + policy.decay * emb[rows[use]]
        c1, c2 = 1 - 0.9 ** step, 1 - 0.99 ** step
        first[rows] = 0.9 * first[rows] + 0.1 * gr
        second[rows] = 0.99 * second[rows] + 0.01 * gr * gr
        emb[rows] -= policy.rate * (first[rows] / c1) / (np.sqrt(second[rows] / c2) + 1e-6)
        gs = grest + policy.decay * rest
        m1 += 0.1 * (gs - m1)
        m2 += 0.01 * (gs * gs - m2)
        rest -= policy.rate * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-6)
        flat[-1] -= policy.rate * float(g.sum())
    return flat


def _sums(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows with equal at."""
    d = rows.shape[1]
    return np.bincount((at.reshape(-1, 1) * d + np.arange(d)).ravel(), rows.ravel(), n * d).reshape(n, d).astype(np.float32)


def _mean(moves: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """How far each number moves after a pass over several parts: the mean of the parts that moved it, by their rows."""
    total, weight = np.zeros(len(moves[0][1])), np.zeros(len(moves[0][1]))
    for n, moved in moves:
        total += n * moved.astype(np.float64)
        weight += n * (moved != 0)
    return (total / np.maximum(weight, 1)).astype(np.float32)


TRAINED, HELD, COUNTS = 0, 1, 2


def _pack(rows: Iterable[tuple], policy: Policy, seen: dict) -> Iterator[tuple[int, dict]]:
    """Batches of (text, toxic, lang, held, trained), with whether they are trained on or held."""
    wait: tuple[list, list] = ([], [])

    def close(k: int) -> tuple[int, dict]:
        texts, y, langs = zip(*wait[k])
        wait[k].clear()
        return k, _batch(texts, policy, seen) | {"y": np.array(y, np.float32), "langs": langs}

    for text, toxic, lang, held, trained in rows:
        for k, use in ((TRAINED, trained), (HELD, held)):
            if use:
                wait[k].append((text, toxic, lang))
                if len(wait[k]) == policy.batch:
                    yield close(k)
    for k in (TRAINED, HELD):
        if wait[k]:
            yield close(k)


def _rounded(batches: list[dict], starts: list[np.ndarray], policy: Policy) -> Counter:
    """Held rows by start, language, rounded output and label."""
    found: Counter = Counter()
    for k, flat in enumerate(starts):
        for b in batches:
            at = np.rint(np.clip(_outputs(b, flat, policy), -LIMIT, LIMIT) * BINS).astype(int).tolist()
            found.update(zip([k] * len(at), b["langs"], at, b["y"].astype(int).tolist()))
    return found


def _chosen(found: dict, starts: list[np.ndarray], policy: Policy) -> Model:
    """The start that ranks the held rows best, calibrated on them. found: their counts by start, language, rounded output
    and label."""
    tables: list[dict] = [{} for _ in starts]
    for (k, lang, at, y), n in found.items():
        for group in (("all",), ("lang", lang)):
            tables[k].setdefault(group, {}).setdefault(at, [0, 0])[y] += n

    def columns(k: int, group: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = sorted(tables[k][group].items())
        return np.array([x / BINS for x, _ in at]), *np.array([n for _, n in at], float).T

    best = -1.0
    for k in range(len(starts)):
        raw, neg, pos = columns(k, ("all",))
        auc = (pos * (np.cumsum(neg) - neg / 2)).sum() / max(1.0, pos.sum() * neg.sum())
        if auc > best:
            best, chosen = auc, k
    emb, conv, bias, out = _split(starts[chosen], policy)
    f = policy.filters
    m = Model(policy, emb, conv, [bias[k * f:(k + 1) * f] for k in range(len(conv))], out, float(starts[chosen][-1]))
    m.scale = _platt(*columns(chosen, ("all",)))

    def threshold(group: tuple) -> tuple[float, float]:
        raw, neg, pos = columns(chosen, group)
        return _threshold(m.score(raw), neg, pos), neg.sum() + pos.sum()

    every, _ = threshold(("all",))
    for group in tables[chosen]:
        if group[0] == "lang":
            own, n = threshold(group)
            m.thresholds[group[1]] = float((n * own + policy.prior * every) / (n + policy.prior))
    m.thresholds[None] = every
    return m


def train(texts: list[str], labels: list[int], langs: list, policy: Policy = Policy()) -> Model:
    """Fit by Adam on logistic loss from ``starts`` random starts, on rows at hand: what ``fit`` does over a table. A fifth
    of the rows of each class tells which network ranks best, and calibrates its score and the thresholds."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return Model(policy, constant=float(y.mean()) if len(y) else 0.0)
    order = np.random.default_rng(policy.seed).permutation(len(y))
    classes = [order[y[order] == k] for k in (0, 1)]
    held = {int(i) for c in classes for i in c[:-(-len(c) // 5)]}
    alone = {int(c[0]) for c in classes if len(c) == 1}
    size, parts, seen = -(-sum(map(len, texts)) // (2 * policy.fit_chars)) or 1, [], {}
    for k in range(size):
        both: tuple[list, list] = ([], [])
        for kind, b in _pack(((texts[i], labels[i], langs[i], i in held, i not in held or i in alone) for i in order[k::size].tolist()), policy, seen):
            both[kind].append(b)
        parts.append(both)
    leaning = _leaning(sum(_counts(p, policy) for p, _ in parts))
    starts = [_first(leaning, policy, policy.seed + k) for k in range(policy.starts)]
    for e in range(policy.epochs):
        for k, flat in enumerate(starts):
            starts[k] = flat + _mean([(_n(p), _epoch(flat, p, policy, _rng(policy, k, e, n)) - flat) for n, (p, _) in enumerate(parts) if p])
    return _chosen(sum((_rounded(h, starts, policy) for _, h in parts), Counter()), starts, policy)


def _n(batches: list[dict]) -> int:
    return sum(len(b["y"]) for b in batches)


def _rng(policy: Policy, start: int, epoch: int, part: int) -> np.random.Generator:
    return np.random.default_rng([policy.seed, start, epoch, part])


def _platt(raw: np.ndarray, neg: np.ndarray, pos: np.ndarray) -> tuple[float, float]:
    """Logistic scaling of outputs with their counts of either label, by Newton steps on softened targets; the slope stays
    positive."""
    n, np_, nn = neg + pos, pos.sum(), neg.sum()
    t = (pos * (np_ + 1) / (np_ + 2) + neg / (nn + 2)) / n
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        w = n * np.maximum(p * (1 - p), 1e-6)
        g = np.array([(n * (p - t) * raw).sum() + 1e-3 * (a - 1), (n * (p - t)).sum()])
        h = np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-9]])
        da, db = np.linalg.solve(h, g)
        a, b = max(0.05, a - np.clip(da, -1, 1)), b - np.clip(db, -2, 2)
    return float(a), float(b)


def _threshold(s: np.ndarray, neg: np.ndarray, pos: np.ndarray) -> float:
    """The cut with the best F1 over rising scores with their counts of either label; of several the middle one."""
    cuts = np.r_[0.0, (s[1:] + s[:-1]) / 2, 1.0]
    hits = pos.sum() - np.r_[0, np.cumsum(pos)]
    taken = (neg + pos).sum() - np.r_[0, np.cumsum(neg + pos)]
    f1 = 2 * hits / np.maximum(taken + pos.sum(), 1)
    return float(np.median(cuts[f1 >= f1.max() - 1e-12])) if pos.sum() else 1.0


def learnable():
    """Rows whose labels may be learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, policy: Policy = Policy()) -> Model:
    """Train on all labelled rows of docs that may be learned from."""
    with C.small_batches(docs.sparkSession):
        return _fit(docs, labels, policy)


def _fit(docs: DataFrame, labels: DataFrame, policy: Policy) -> Model:
    marks = C.materialize(labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
                          .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & learnable()).distinct(), "toxic-marks")
    n_marks = marks.count()
    named = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & learnable()).withColumn("hash", F.xxhash64("doc_id", "text"))
    sizes = C.sized_join(named.select("doc_id", "hash", F.length("text").cast("long").alias("chars")), marks, "doc_id", "inner", n_marks)
    ends = {r.toxic: r for r in sizes.groupBy("toxic").agg(F.min("hash").alias("low"), F.max("hash").alias("high"), F.sum("chars").alias("chars")).collect()}
    if len(ends) < 2:
        return Model(policy, constant=float(sum(ends)))
    n_parts = -(-sum(r.chars for r in ends.values()) // (2 * policy.fit_chars)) or 1
    parts = C.materialize(_parts(C.sized_join(named, marks, "doc_id", "inner", n_marks), ends, n_parts, policy), "toxic-parts")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            held = np.frombuffer(row["data"], "<i4").reshape(2, -1)
            y, at = np.nonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(at, pa.int32()), pa.array(held[y, at].astype(np.int64))], ["toxic", "at", "n"])

    held = np.zeros((2, policy.buckets + 1))
    sums = parts.where(F.col("kind") == COUNTS).select("data").mapInArrow(counted, "toxic int, at int, n long").groupBy("toxic", "at").agg(F.sum("n").alias("n")).toArrow()
    held[sums["toxic"].to_numpy(), sums["at"].to_numpy()] = sums["n"].to_numpy()
    leaning = _leaning(held)
    starts = [_first(leaning, policy, policy.seed + k) for k in range(policy.starts)]
    for e in range(policy.epochs):
        starts = _pass(parts, starts, policy, e)
    sent = docs.sparkSession.sparkContext.broadcast(starts)

    def rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for row in _each(batches):
            found.update(_rounded([pickle.loads(row["data"])], sent.value, policy))
        if found:
            yield pa.RecordBatch.from_pylist([dict(zip(("start", "lang", "at", "toxic", "n"), (*k, n))) for k, n in found.items()], pa.schema(
                [("start", pa.int32()), ("lang", pa.string()), ("at", pa.int32()), ("toxic", pa.int32()), ("n", pa.int64())]))

    found = (parts.where(F.col("kind") == HELD).select("data").mapInArrow(rounded, "start int, lang string, at int, toxic int, n long")
             .groupBy("start", "lang", "at", "toxic").agg(F.sum("n").alias("n")).toArrow().to_pylist())
    sent.destroy()
    found.sort(key=lambda r: (r["start"], r["lang"] is not None, r["lang"] or "", r["at"], r["toxic"]))
    return _chosen({(r["start"], r["lang"], r["at"], r["toxic"]): r["n"] for r in found}, starts, policy)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _parts(rows: DataFrame, ends: dict, n_parts: int, policy: Policy) -> DataFrame:
    """The batches of each part, and the document counts of those trained on. Equal rows count once."""
    part = F.pmod(F.xxhash64("hash"), F.lit(n_parts)).cast("int")
    end = lambda name: F.when(F.col("toxic") == 1, F.lit(ends[1][name])).otherwise(F.lit(ends[0][name]))
    # Of each class the row with the lowest hash is held and that with the highest is trained on, so that both have one.
    held = ((F.pmod("hash", F.lit(5)) == 0) & (F.col("hash") != end("high"))) | (F.col("hash") == end("low"))
    trained = ~F.col("held") | F.lit(ends[0].low == ends[0].high) & (F.col("toxic") == 0) | F.lit(ends[1].low == ends[1].high) & (F.col("toxic") == 1)
    dealt = (rows.withColumn("part", part).withColumn("held", held).withColumn("trained", trained)
             .select("part", "hash", "doc_id", "text", "toxic", "lang", "held", "trained"))

    def line(part: int, kind: int, data: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], ["part", "kind", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        now: list = [None]  # the first row of the next part

        def one(source: Iterator[tuple]) -> Iterator[tuple]:
            row, now[0], last = now[0], None, None
            while row is not None:
                if row[2:6] != last:
                    last = row[2:6]
                    yield row[3], row[4], row[5], row[6], row[7]
                new = next(source, None)
                if new is not None and new[0] != row[0]:
                    now[0] = new
                    return
                row = new

        source = (row for b in batches for k in range(0, b.num_rows, 256) for row in zip(*(c.to_pylist() for c in b.slice(k, 256).columns)))
        now[0] = next(source, None)
        while now[0] is not None:
            at, counts = now[0][0], np.zeros((2, policy.buckets + 1))
            for kind, b in _pack(one(source), policy, seen):
                if kind == TRAINED:
                    counts += _counts([b], policy)
                yield line(at, kind, pickle.dumps(b))
            yield line(at, COUNTS, counts.astype("<i4").tobytes())

    return (dealt.repartitionById(n_parts, F.col("part")).sortWithinPartitions("part", "hash", "doc_id", "text", "toxic", "lang")
            .mapInArrow(run, "part int, kind int, data binary"))


def _pass(parts: DataFrame, starts: list[np.ndarray], policy: Policy, epoch: int) -> list[np.ndarray]:
    """The networks after one epoch over all parts: a task for each part and start, merged by blocks of numbers."""
    ours = parts.where(F.col("kind") == TRAINED)
    rows = ours.select("part", F.lit(0).alias("start"), "data")
    for k in range(1, len(starts)):
        rows = rows.union(ours.select("part", F.lit(k).alias("start"), "data"))
    names = ["start", "block", "part", "n", "data"]
    # Sent by hand, since what goes with a function stays on every executor's disk.
    sent = parts.sparkSession.sparkContext.broadcast(starts)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (k, part), lines in groupby(_each(batches), lambda r: (r["start"], r["part"])):
            some = [pickle.loads(r["data"]) for r in lines]
            moved = _epoch(sent.value[k], some, policy, _rng(policy, k, epoch, part)) - sent.value[k]
            data = [moved[a:a + BLOCK].tobytes() for a in range(0, len(moved), BLOCK)]
            m = len(data)
            yield pa.RecordBatch.from_arrays([pa.array([k] * m, pa.int32()), pa.array(range(m), pa.int32()), pa.array([part] * m, pa.int32()),
                                              pa.array([_n(some)] * m, pa.int64()), pa.array(data, pa.binary())], names)

    def merge(table: pa.Table) -> pa.Table:
        of = sorted(table.to_pylist(), key=lambda r: (r["part"], r["n"]))  # the same order of sums in every run
        mean = _mean([(r["n"], np.frombuffer(r["data"], np.float32)) for r in of])
        return pa.table([pa.array([of[0]["start"]], pa.int32()), pa.array([of[0]["block"]], pa.int32()), pa.array([mean.tobytes()], pa.binary())],
                        ["start", "block", "data"])

    out = [s.copy() for s in starts]
    merged = rows.mapInArrow(learn, "start int, block int, part int, n long, data binary").groupBy("start", "block").applyInArrow(merge, "start int, block int, data binary")
    for r in merged.collect():
        out[r.start][r.block * BLOCK:(r.block + 1) * BLOCK] += np.frombuffer(bytes(r.data), np.float32)
    sent.destroy()
    return out


def score(docs: DataFrame, model: Model, *columns: str) -> DataFrame:
    """The given columns of docs and the score of every whole text."""
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, seen = model.policy, {}
        table = np.zeros((1024, p.dim), np.float32)  # row 0 is the gap
        over = max(p.widths) - 1 or 1
        for batch in batches:
            text = batch.column(len(columns))
            for k in range(0, batch.num_rows, 256):
                part = text.slice(k, 256).to_pylist()
                here = [batch.column(c).slice(k, 256) for c in range(len(columns))]
                if model.constant is not None:
                    s = np.full(len(part), model.constant)
                else:
                    if len(seen) > p.cache_words:
                        seen.clear()
                    docs_ = [_WORDS.findall((t or "").lower()) for t in part]
                    new = list(set().union(*docs_) - seen.keys())
                    if new:
                        need = len(seen) + len(new) + 1
                        if need > len(table):
                            table = np.vstack([table, np.zeros((max(need, 2 * len(table)) - len(table), p.dim), np.float32)])
                        vec = model.emb[np.array([features(w, p.buckets) for w in new])].mean(axis=1)
                        at = len(seen) + 1
                        table[at:at + len(new)] = vec
                        seen.update((w, at + n) for n, w in enumerate(new))
                    get = seen.__getitem__
                    ids, starts, gap = _layout([np.fromiter(map(get, w), np.int64, len(w)) for w in docs_], 0, over)
                    top = np.empty((len(part), p.filters * len(p.widths)), np.float32)
                    # Blocks of whole documents; one long document is a block of its own.
                    a = 0
                    while a < len(part):
                        b = max(a + 1, int(np.searchsorted(starts, starts[a] + 100_000)))
                        end = starts[b] if b < len(part) else len(ids)
                        top[a:b] = model.pooled(table[ids[starts[a]:end]], starts[a:b] - starts[a], gap[starts[a]:end])[0]
                        a = b
                    s = model.score(model.raw(top))
                yield pa.RecordBatch.from_arrays([*here, pa.array(s, pa.float64())], [*columns, "score"])

    return docs.select(*columns, "text").mapInArrow(run, schema)


def flag(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, score and the verdict at the threshold of the document's language."""
    own = {lang: t for lang, t in model.thresholds.items() if lang is not None}
    # As an Arrow table: of a list, Spark would make rows in Python workers that then stay beside those that score.
    cuts = docs.sparkSession.createDataFrame(pa.table([pa.array(own, pa.string()), pa.array(own.values(), pa.float64())], ["lang", "cut"]))
    cut = F.coalesce(F.col("cut"), F.lit(model.thresholds.get(None, 0.5)))
    return (C.sized_join(score(docs, model, "doc_id", "lang"), cuts, "lang", "left", len(own))
            .select("doc_id", "lang", "score", (F.col("score") >= cut).cast("int").alias("toxic")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    with C.small_batches(spark):  # what is scored here, while that holds, is written: narrow rows, no text
        found = C.materialize(flag(docs, model), "toxic-scores")
    return found.select("doc_id", (~F.coalesce(learnable(), F.lit(True))).alias("held_out"), "score",
                        (F.col("score") >= 0.7).cast("int").alias("predicted"), F.col("toxic").alias("toxic_by_lang"))


QUERIES = {"op7_toxicity": op7_toxicity}
SQL: dict[str, str] = {}
