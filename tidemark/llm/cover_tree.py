"""Exact near-duplicate embeddings by cover trees and dual traversal.

Equal vectors are folded into one row with a weight. The upper tree is grown across the cluster, all large nodes of a
round at once: a node of radius r takes a net of radius r / 2 from a sample of its rows, its own centre first (levels
are nested), every row goes to its nearest centre within r / 2, and rows that no centre covers make a node that is
sampled again at the same radius. A node is a leaf when it has at most ``block`` rows, when all of its rows are linked
with each other whatever their places (twice its radius is within the link distance), or when it is flat: half of a
sample or more lies in nodes of its own, so that halving the radius splits nothing. Leaves are cut into blocks of at
most ``block`` rows, and a block's rows make a cover tree of their own in one task: nested nets of radii 1, 1/2 ... 1/64,
each separated by its radius, then the vectors.

Both trees are descended by pairs: pairs of nodes of the upper tree are rows, joined with their children level by
level and dropped when the centres lie further apart than the covering radii and the link distance allow. Covering radii
are measured, not assumed. Pairs of leaves that are linked as a whole are counted from their weights; the other pairs of
leaves meet block by block in a task, where node pairs are dropped, taken as a whole or opened, and pairs of vectors are
verified by their cosine in double precision. A task returns link counts and a spanning forest, never all pairs; the
driver holds no row per node, block or pair.

Data without structure (random directions in many dimensions: no radius below the root's gathers anything) has a flat root.
Then all blocks meet and the work is quadratic in the number of distinct vectors: that is the method's limit, not a cap.

Cases: null, empty, zero and non-finite vectors, and rows without an id, link with nothing (their component is their
own id); shorter vectors are read as padded with zeros; repeated rows count as other vectors; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import connected_components

COSINE = 0.9
#: Rows of a large node, on average, from which the centres of its children are chosen.
SAMPLE = 1024
#: Vectors in a block: at most this many, and an eighth of all where that is less.
BLOCK = 8192
#: Radii of a block's tree below the root (any two directions lie within 2 of each other).
RADII = tuple(2.0 ** -k for k in range(7))
#: Vectors from which a node that is not tight is worth a look of its own.
FEW = 8
_EPS = 1e-9
#: Margins that rounding cannot cross: of single precision when node pairs are sought, of the bound for whole pairs.
_SINGLE, _WHOLE = 1e-5, 1e-6


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    ends = np.asarray(column.offsets)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(ends)
    if len(sizes) and (sizes == dim).all():
        return flat[ends[0]:ends[-1]].reshape(-1, dim)
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        out[i, :b - a] = flat[a:b]
    return out


def net(x: np.ndarray, first: np.ndarray, radius: float) -> np.ndarray:
    """Indices of a greedy net that begins with ``first``: no later one within radius of another, every vector within
    radius of one (up to single precision; radii are measured afterwards)."""
    least = np.float32(1 - radius * radius / 2)
    chosen = np.zeros(len(x), bool)
    chosen[first] = True
    at = np.flatnonzero(chosen)
    for s in range(0, len(x), 512):
        own = np.arange(s, min(s + 512, len(x)))
        own = own[~chosen[own]]
        if len(at) and len(own):
            own = own[(x[own] @ x[at].T).max(axis=1) < least]
        if not len(own):
            continue
        near = x[own] @ x[own].T >= least
        free, new = np.ones(len(own), bool), []
        for i in range(len(own)):
            if free[i]:
                new.append(own[i])
                free &= ~near[i]
        chosen[new] = True
        at = np.r_[at, new]
    return np.flatnonzero(chosen)


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    for s in range(0, len(x), 2048):
        at[s:s + 2048] = (x[s:s + 2048] @ centers.T).argmax(axis=1)
    return at


def tree(x: np.ndarray, tight: float) -> np.ndarray:
    """For each unit vector (rows of x) the index of its node's centre at every radius of RADII. A node of fewer than FEW
    vectors that is not tight prunes nothing; its children stand in its place."""
    x = x.astype(np.float32)
    n = len(x)
    levels, live, centers = [], np.arange(n), np.zeros(0, np.int64)
    for radius in RADII:
        near = np.arange(n)  # a vector alone in its node stays its own centre further down
        if len(live):
            place = np.searchsorted(live, centers)
            centers = live[net(x[live], place, radius)]
            near[live] = centers[nearest(x[live], x[centers])]
            near[centers] = centers
            levels.append(near)
            live = live[np.bincount(near[live], minlength=n)[near[live]] > 1]
            centers = np.intersect1d(centers, live)
        else:
            levels.append(near)
    below = np.arange(n)
    for k in range(len(levels) - 1, -1, -1):
        at = levels[k][below]  # a vector is where the centre of its node below is
        far = np.zeros(n, np.float32)
        np.maximum.at(far, at, np.linalg.norm(x - x[at], axis=1))
        open_ = (np.bincount(at, minlength=n)[at] < FEW) & (far[at] > tight)
        levels[k] = below = np.where(open_, below, at)
    return np.stack(levels, axis=1).astype(np.int32)


class Side:
    """One block's tree. Vectors are put in an order in which every node's vectors, and children, are neighbours."""

    def __init__(self, x: np.ndarray, nodes: np.ndarray, weight: np.ndarray):
        unit = _unit(x)
        far = [np.linalg.norm(unit - unit[nodes[:, k]], axis=1) for k in range(nodes.shape[1])]
        radius = []
        for k, d in enumerate(far):
            r = np.zeros(len(x))
            np.maximum.at(r, nodes[:, k], d)
            radius.append(r[nodes[:, k]])
        # Single vectors first: what they meet is judged by one bound.
        keys = [np.arange(len(x))]
        for k in range(nodes.shape[1] - 1, -1, -1):
            keys += [nodes[:, k], radius[k]]
        self.order = np.lexsort(keys)
        self.raw, self.unit, self.weight = x[self.order], unit[self.order], weight[self.order]
        self.norm, self.single = np.linalg.norm(self.raw, axis=1), self.unit.astype(np.float32)
        self.upto = np.r_[0, np.cumsum(self.weight)]
        n = len(x)
        # Per level (the root, the radii, the vectors): first vector, end, centre and radius of each node.
        self.levels = [(np.array([0]), np.array([n]), np.array([0]), np.array([2.0]))]
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        for k in range(nodes.shape[1]):
            own = nodes[self.order, k]
            s = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            self.levels.append((s, np.r_[s[1:], n], place[own[s]], radius[k][self.order][s]))
        every = np.arange(n)
        self.levels.append((every, every + 1, every, np.zeros(n)))

    def children(self, level: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place and number, in the next level, of the children of nodes."""
        s, e, _, _ = self.levels[level]
        below = self.levels[level + 1][0]
        a = np.searchsorted(below, s[of])
        return a, np.searchsorted(below, e[of]) - a


def dual(a: Side, b: Side, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Descend both trees together (b may be a itself). Returns the links of a's and of b's vectors, and edges of a forest:
    places in a followed by those in b."""
    reach = sqrt(max(0.0, 2 - 2 * cosine))
    own, n = a is b, len(a.unit)
    shift = 0 if own else n
    more = [np.zeros(n + 1, np.int64), np.zeros(len(b.unit) + 1, np.int64)]  # differences between neighbours
    selves = np.zeros(n + 1, np.int64)
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    none = np.zeros(0, np.int64)
    p, q = np.array([0]), np.array([0])

    def judge(level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of node pairs those to open; pairs linked as a whole are counted."""
        sa, ea, ca, ra = a.levels[level]
        sb, eb, cb, rb = b.levels[level]
        up = ra[i] + rb[j]
        dots = np.einsum("ij,ij->i", a.single[ca[i]], b.single[cb[j]]).astype(np.float64)
        near = dots >= 1 - (up + reach) ** 2 / 2 - _SINGLE
        # The few that may be whole are judged in double precision.
        at = np.flatnonzero(np.sqrt(np.maximum(0, 2 - 2 * dots)) + up <= reach + 0.01)
        d = np.sqrt(((a.unit[ca[i[at]]] - b.unit[cb[j[at]]]) ** 2).sum(axis=1))
        whole = np.zeros(len(i), bool)
        whole[at[d + up[at] <= reach - _WHOLE]] = True
        u, v = i[whole], j[whole]
        if len(u):
            # Of a node's pair with itself every vector has all others.
            np.add.at(more[0], sa[u], b.upto[eb[v]] - b.upto[sb[v]])
            np.subtract.at(more[0], ea[u], b.upto[eb[v]] - b.upto[sb[v]])
            if own:
                same = u == v
                np.add.at(selves, sa[u[same]], 1)
                np.subtract.at(selves, ea[u[same]], 1)
                u, v = u[~same], v[~same]
            extra = more[0] if own else more[1]
            np.add.at(extra, sb[v], a.upto[ea[u]] - a.upto[sa[u]])
            np.subtract.at(extra, eb[v], a.upto[ea[u]] - a.upto[sa[u]])
            edges.append((sa[i[whole]], sb[j[whole]] + shift))
            for nodes, (s, e), off in ((np.unique(i[whole]), (sa, ea), 0), (np.unique(j[whole]), (sb, eb), shift)):
                size = e[nodes] - s[nodes]
                inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                edges.append((np.repeat(s[nodes], size) + off, np.repeat(s[nodes], size) + inside + off))
        near &= ~whole
        return i[near], j[near]

    def dense(level: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of nodes i x j that may be near, by products of matrices."""
        _, _, ca, ra = a.levels[level]
        _, _, cb, rb = b.levels[level]
        zero_a, zero_b = int((ra[i] > 0).argmax()) if (ra[i] > 0).any() else len(i), int((rb[j] > 0).argmax()) if (rb[j] > 0).any() else len(j)
        for x in (i[:zero_a], i[zero_a:]):
            for y in (j[:zero_b], j[zero_b:]):
                if not len(x) or not len(y):
                    continue
                right = b.single[cb[y]].T
                bound = None if not (ra[x].any() or rb[y].any()) else rb[y].astype(np.float32)
                step = max(1, 4_000_000 // len(y))
                for s in range(0, len(x), step):
                    dots = a.single[ca[x[s:s + step]]] @ right
                    if bound is None:
                        hit = dots >= np.float32(1 - reach * reach / 2 - _SINGLE)
                    else:
                        up = ra[x[s:s + step]].astype(np.float32)[:, None] + (bound[None, :] + np.float32(reach))
                        hit = dots >= 1 - up * up / 2 - np.float32(_SINGLE)
                    some = np.flatnonzero(hit.any(axis=1))
                    r, c = np.nonzero(hit[some])
                    yield x[s + some[r]], y[c]

    for level in range(1, len(a.levels)):
        next_p, next_q = [none], [none]

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            if own:  # each pair once
                i, j = i[i <= j], j[i <= j]
            for s in range(0, len(i), 200_000):
                x, y = judge(level, i[s:s + 200_000], j[s:s + 200_000])
                next_p.append(x)
                next_q.append(y)

        for t in range(0, len(p), 200_000):
            (x, nx), (y, ny) = a.children(level - 1, p[t:t + 200_000]), b.children(level - 1, q[t:t + 200_000])
            big = nx * ny > 4096
            for i0, ni, j0, nj in zip(x[big], nx[big], y[big], ny[big]):
                for i, j in dense(level, np.arange(i0, i0 + ni), np.arange(j0, j0 + nj)):
                    keep(i, j)
            x, nx, y, ny = x[~big], nx[~big], y[~big], ny[~big]
            m = nx * ny
            cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(m) // 500_000)) + 1, len(m)]
            for u, v in zip(cuts[:-1], cuts[1:]):
                pair = np.repeat(np.arange(u, v), m[u:v])
                k = np.arange(len(pair)) - np.repeat(np.cumsum(m[u:v]) - m[u:v], m[u:v])
                keep(x[pair] + k // ny[pair], y[pair] + k % ny[pair])
        p, q = np.concatenate(next_p), np.concatenate(next_q)
    # Pairs of vectors too near the limit to be judged by bounds.
    links = [np.cumsum(x)[:-1] for x in more]
    if own:
        links[0] -= np.cumsum(selves)[:-1] * a.weight
        p, q = p[p != q], q[p != q]
    for s in range(0, len(p), 500_000):
        i, j = p[s:s + 500_000], q[s:s + 500_000]
        cos = np.einsum("ij,ij->i", a.raw[i], b.raw[j]) / (a.norm[i] * b.norm[j])
        i, j = i[cos >= cosine], j[cos >= cosine]
        np.add.at(links[0], i, b.weight[j])
        np.add.at(links[0] if own else links[1], j, a.weight[i])
        edges.append((i, j + shift))
    from_, to = (np.concatenate([none, *x]) for x in zip(*edges)) if edges else (none, none)
    return links[0], links[1], from_, to


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each vector's component under the pairs (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, before, label)  # a component's old name follows
        label = label[label]
        if (label == before).all():
            break
    return label


def _pick(dim: int):
    """Rows of one large node after the other, sorted by node, its own centre first: the centres of its children, or
    one row that calls it flat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.sorted_groups(batches, 1):
            x = _unit(_matrix(t.column("embedding").chunk(0), dim))
            level, own = t.column("level")[0].as_py(), int(t.column("uid")[0].as_py() < 0)
            at = net(x.astype(np.float32), np.arange(own), 2.0 ** -level)
            flat = 2 * len(at) > len(x)
            at = at[:1] if flat else at
            yield pa.RecordBatch.from_arrays(
                [t.column("node").chunk(0).take(pa.array(at)), pa.array(np.full(len(at), level + 1, np.int32)),
                 pa.array(np.arange(len(at))), t.column("embedding").chunk(0).take(pa.array(at)),
                 pa.array(np.full(len(at), flat))], ["node", "level", "child", "embedding", "flat"])

    return run


def _assign(dim: int):
    """Rows of one piece of a large node, the centres first: each row with its nearest centre (-1: none within the radius)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.sorted_groups(batches, 2):
            child = t.column("child").to_numpy()
            n = int(np.searchsorted(child, _ROW))
            t, heads = t.slice(n), t.slice(0, n)
            if not t.num_rows:
                continue
            x, centers = (_unit(_matrix(y.combine_chunks().column("embedding").chunk(0), dim)) for y in (t, heads))
            at = nearest(x.astype(np.float32), centers.astype(np.float32))
            dist = np.linalg.norm(x - centers[at], axis=1)
            none = dist > 2.0 ** (1 - heads.column("level")[0].as_py())
            dist[none] = t.column("dist").to_numpy()[none]
            level = heads.column("level")[0].as_py() - none
            cols = {c: t.column(c).combine_chunks() for c in ("uid", "weight", "embedding", "node")}
            cols |= {"level": pa.array(level.astype(np.int32)), "child": pa.array(np.where(none, -1, at)), "dist": pa.array(dist)}
            yield from pa.table(cols).to_batches()

    return run


#: In place of a child's number: the row is a vector, not a centre.
_ROW = 1 << 40


def _grow(dim: int, cosine: float):
    """A tree for every block, its rows sorted by uid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.sorted_groups(batches, 1):
            nodes = tree(_unit(_matrix(t.column("embedding").chunk(0), dim)), sqrt(max(0.0, 2 - 2 * cosine)) / 2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, nodes.size + 1, nodes.shape[1], dtype=np.int32)),
                                             pa.array(nodes.ravel()))
            yield pa.RecordBatch.from_arrays([t.column(c).chunk(0) for c in t.column_names] + [lists], [*t.column_names, "nodes"])

    return run


def _tiles(dim: int, cosine: float):
    """Rows of one pair of blocks after the other, sorted by block and uid: links and roots of the vectors that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.sorted_groups(batches, 2):
            block, uid, weight = (t.column(c).to_numpy() for c in ("block", "uid", "weight"))
            x = _matrix(t.column("embedding").chunk(0), dim)
            nodes = t.column("nodes").chunk(0).flatten().to_numpy().reshape(-1, len(RADII))
            cuts = np.flatnonzero(np.diff(block)) + 1
            parts = np.split(np.arange(len(block)), cuts)
            if len(parts) == 1 and t.column("a")[0].as_py() != t.column("b")[0].as_py():
                continue
            sides = [Side(x[p], nodes[p], weight[p]) for p in parts]
            la, lb, i, j = dual(sides[0], sides[-1], cosine)
            place = np.concatenate([p[s.order] for p, s in zip(parts, sides)])
            links = np.zeros(len(uid), np.int64)
            links[place] = np.concatenate([la, lb][:len(parts)])
            # Blocks are apart in the table and so are their uids; the smallest place stands for a component.
            root = _forest(len(uid), place[i], place[j])
            hit = np.flatnonzero(links > 0)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(uid[hit]), pa.array(uid[root[hit]]), pa.array(links[hit])],
                                                 ["uid", "root", "links"])

    return run


def links(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id of every row."""
    v = vectors.select("vec_id", "embedding")
    good = (F.col("vec_id").isNotNull() & F.coalesce(F.size("embedding") > 0, F.lit(False))
            & F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
            & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False)))
    v = v.withColumn("ok", good).withColumn("h1", F.when(good, F.xxhash64("embedding"))).withColumn(
        "h2", F.when(good, F.xxhash64(F.lit(1), "embedding")))
    u = (v.where("ok").groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"),
                                               F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first")))
    u = C.materialize(u.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    n, dim = u.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if n:
        found = C.materialize(_search(u, n, dim, cosine, block, sample), "links")
        counts = found.groupBy("uid").agg(F.sum("links").alias("links"))
        roots = connected_components(found.select(F.col("uid").alias("a"), F.col("root").alias("b")))
        named = u.select("h1", "h2", "uid", "weight", "first").join(counts, "uid", "left").join(
            roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
        ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
        named = named.join(ids, "root").select("h1", "h2", "component_id", (
            F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    else:
        named = u.select("h1", "h2", F.col("first").alias("component_id"), F.col("weight").alias("n_links"))
    return v.join(named, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))


def upper_tree(u: DataFrame, n: int, dim: int, cosine: float, size: int, sample: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, placed): every node with its parent, centre (a vector; null at the root), radius and whether it is a leaf;
    every row with its leaf and the block of the leaf it is dealt to."""
    spark, reach = u.sparkSession, sqrt(max(0.0, 2 - 2 * cosine))
    kind = u.schema["embedding"].dataType.simpleString()
    rows = u.select("uid", "weight", "embedding", F.lit(0).cast("long").alias("node"), F.lit(0).alias("level"),
                    F.lit(2.0).alias("dist"))
    heads = spark.createDataFrame([(0, None, None)], f"node long, parent long, center {kind}")
    nodes, placed, turn = [], [], 0
    while True:
        turn += 1
        stats = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius"), F.max("level").alias("level"))
        tight = 2 * F.col("radius") <= reach - _WHOLE
        now = C.materialize(heads.join(stats, "node").withColumn("open", (F.col("n") > size) & ~tight), "nodes")
        large = now.where("open").select("node", "n", "center")
        n_large = large.count()
        picked = None
        if n_large:
            chance = F.pmod(F.xxhash64(F.lit(turn), "uid"), F.lit(1 << 30)) * F.col("n") < F.lit(sample << 30)
            some = C.sized_join(rows, large, "node", "inner", n_large).where(chance).select("node", "level", "uid", "embedding")
            own = now.where("open AND center IS NOT NULL").select("node", "level", F.lit(-1).cast("long").alias("uid"), F.col("center").alias("embedding"))
            picked = C.materialize(some.union(own).repartition("node").sortWithinPartitions("node", "uid").mapInArrow(
                _pick(dim), f"node long, level int, child long, embedding {kind}, flat boolean"), "picked")
            now = now.join(picked.where("NOT flat").select("node").distinct().withColumn("split", F.lit(True)), "node", "left")
        else:
            now = now.withColumn("split", F.lit(False))
        now = C.materialize(now.withColumn("leaf", ~F.coalesce("split", F.lit(False))).withColumn(
            "pieces", F.ceil(F.col("n") / size).cast("int")).drop("split", "open"), "decided")
        nodes.append(now.select("node", "parent", "center", "radius", "leaf", "pieces"))
        part = now.select("node", "leaf", "pieces")
        dealt = C.sized_join(rows, part, "node", "inner").withColumn("piece", F.pmod(F.xxhash64("uid"), "pieces").cast("int"))
        placed.append(dealt.where("leaf").select("uid", "weight", "embedding", "node", "piece"))
        if now.where("NOT leaf").limit(1).count() == 0:
            break
        picked = picked.where("NOT flat")
        each = picked.join(now.where("NOT leaf").select("node", "pieces"), "node").select(
            "node", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "child", F.lit(-1).cast("long").alias("uid"),
            F.lit(0).cast("long").alias("weight"), "embedding", "level", F.lit(0.0).alias("dist"))
        both = each.union(dealt.where("NOT leaf").select(
            "node", "piece", F.lit(_ROW).alias("child"), "uid", "weight", "embedding", "level", "dist"))
        moved = (both.repartition("node", "piece").sortWithinPartitions("node", "piece", "child").mapInArrow(
            _assign(dim), f"uid long, weight long, embedding {kind}, node long, level int, child long, dist double"))
        name = F.xxhash64("node", "child")
        rows = C.materialize(moved.withColumn("node", name).drop("child"), "rows")
        rest = now.where("NOT leaf").select("node", "center", F.lit(-1).cast("long").alias("child"))
        heads = picked.select("node", F.col("embedding").alias("center"), "child").union(rest).select(
            name.alias("node"), F.col("node").alias("parent"), "center")
    every, dealt = nodes[0], placed[0]
    for x, y in zip(nodes[1:], placed[1:]):
        every, dealt = every.union(x), dealt.union(y)
    return C.materialize(every, "tree"), C.materialize(dealt, "placed")


def leaf_pairs(nodes: DataFrame, cosine: float) -> DataFrame:
    """(a, b, whole) for pairs of leaves that may hold linked vectors, a pair once: both trees descended level by level."""
    reach = sqrt(max(0.0, 2 - 2 * cosine))
    norm = "sqrt(aggregate({0}, 0D, (t, x) -> t + CAST(x AS DOUBLE) * x))"
    nodes = C.materialize(nodes.withColumn("unit", F.expr(
        f"transform(array({norm.format('center')}), m -> transform(center, x -> x / m))[0]")).drop("center"), "units")
    columns = ["node", "unit", "radius", "leaf"]
    kids = nodes.where("parent IS NOT NULL").select("parent", *columns).union(
        nodes.where("leaf").select(F.col("node").alias("parent"), *columns))
    side = lambda s: kids.select(*[F.col(c).alias(s if c == "parent" else s + c) for c in ["parent", *columns]])
    d = F.expr("CASE WHEN aunit IS NULL OR bunit IS NULL THEN 0D ELSE sqrt(greatest(0D, aggregate(sequence(1, greatest(size(aunit), "
               "size(bunit))), 0D, (t, i) -> t + pow(coalesce(try_element_at(aunit, i), 0D) - coalesce(try_element_at(bunit, i), 0D), 2)))) END")
    root = nodes.where("parent IS NULL")
    pairs = root.select(F.col("node").alias("a"), F.col("node").alias("b"), F.col("leaf").alias("aleaf"), F.col("leaf").alias("bleaf"),
                        (2 * F.col("radius") <= reach - _WHOLE).alias("whole"))
    done = None
    while True:
        ends = pairs.where("aleaf AND bleaf").select("a", "b", "whole")
        done = ends if done is None else done.union(ends)
        rest = pairs.where("NOT (aleaf AND bleaf)").select("a", "b")
        if not rest.limit(1).count():
            return C.materialize(done, "pairs")
        met = rest.join(side("a"), "a").join(side("b"), "b").where("a <> b OR anode <= bnode").withColumn("d", F.when(
            F.col("anode") == F.col("bnode"), F.lit(0.0)).otherwise(d))
        reached = F.col("d") <= F.col("aradius") + F.col("bradius") + (reach + _EPS)
        whole = (F.col("aunit").isNotNull() & F.col("bunit").isNotNull()
                 & (F.col("d") + F.col("aradius") + F.col("bradius") <= reach - _WHOLE))
        pairs = C.materialize(met.where(reached | F.col("aunit").isNull() | F.col("bunit").isNull()).select(
            F.col("anode").alias("a"), F.col("bnode").alias("b"), "aleaf", "bleaf", whole.alias("whole")), "met")


def _search(u: DataFrame, n: int, dim: int, cosine: float, block: int, sample: int) -> DataFrame:
    """(uid, root, links): parts of the link counts, and edges that join what is linked."""
    size = max(1, min(block, -(-n // 8)))
    nodes, placed = upper_tree(u, n, dim, cosine, size, sample)
    pairs = leaf_pairs(nodes, cosine)
    # Leaves linked as a whole: counts from their weights.
    leaves = placed.groupBy("node").agg(F.sum("weight").alias("all"), F.min("uid").alias("rep"))
    whole = pairs.where("whole")
    ways = whole.select(F.col("a").alias("node"), F.col("b").alias("other")).union(whole.where("a <> b").select("b", "a"))
    others = leaves.select(F.col("node").alias("other"), F.col("all").alias("more"), F.col("rep").alias("to"))
    ways = C.materialize(ways.join(others, "other"), "whole")
    gain = ways.groupBy("node").agg(F.sum("more").alias("more"), F.max(F.col("node") == F.col("other")).alias("self"))
    counted = placed.select("uid", "weight", "node").join(gain.join(leaves.select("node", "rep"), "node"), "node").select(
        "uid", F.col("rep").alias("root"), (F.col("more") - F.when(F.col("self"), F.col("weight")).otherwise(0)).alias("links"))
    bridges = ways.join(leaves.select("node", "rep"), "node").select(F.col("rep").alias("uid"), F.col("to").alias("root"),
                                                                      F.lit(0).cast("long").alias("links"))
    # The others meet block by block.
    pieces = nodes.where("leaf").select("node", "pieces")
    tiles = (pairs.where("NOT whole").join(pieces.select(F.col("node").alias("a"), F.col("pieces").alias("pa")), "a")
             .join(pieces.select(F.col("node").alias("b"), F.col("pieces").alias("pb")), "b")
             .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("pa") - 1)))
             .withColumn("j", F.explode(F.sequence(F.when(F.col("a") == F.col("b"), F.col("i")).otherwise(F.lit(0)), F.col("pb") - 1))))
    tiles = tiles.select(F.xxhash64("a", "i").alias("x"), F.xxhash64("b", "j").alias("y"))
    tiles = tiles.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    meets = C.materialize(tiles.select(F.col("a").alias("block"), "a", "b").union(
        tiles.where("a <> b").select(F.col("b").alias("block"), "a", "b")), "meets")
    kind = u.schema["embedding"].dataType.simpleString()
    grown = C.materialize(
        placed.select(F.xxhash64("node", "piece").alias("block"), "uid", "weight", "embedding").repartition("block")
        .sortWithinPartitions("block", "uid")
        .mapInArrow(_grow(dim, cosine), f"block long, uid long, weight long, embedding {kind}, nodes array<int>"), "blocks")
    met = C.sized_join(grown, meets, "block", "inner").select("a", "b", "block", "uid", "weight", "embedding", "nodes")
    return (met.repartition("a", "b").sortWithinPartitions("a", "b", "block", "uid")
            .mapInArrow(_tiles(dim, cosine), "uid long, root long, links long").union(counted).union(bridges))


def op5_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select(
        "vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


QUERIES = {"op5_cover_tree": op5_cover_tree}
SQL: dict[str, str] = {}
