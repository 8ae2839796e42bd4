"""Exact n-gram Jaccard join in the metric space of shingle sets.

d = 1 - Jaccard is a metric, and documents link when d <= r = 0.15 (100 * |A and B| >= 85 * |A or B|).

1. *Classes.* Documents with equal sets are one class (a fingerprint of the set). A fixed-size sketch of
   shingle counts orders all shingles, frequent ones last.
2. *Cells.* By the prefix bound, linked sets share one of their first n - ceil(0.85 n) + 1 shingles in
   that order. Classes that share no such cell with another have no links and leave.
3. *Voronoi regions.* In rounds, classes with the same min-hash meet (hot ones in salted groups); the most
   central become pivots, and every other class is paired with the pivots that may be within r. Pairs are
   then compared exactly: a class joins the region of its nearest pivot within r and is linked to every
   pivot within r. So a large group of near copies costs a few comparisons for each of its
   members, not all pairs.
4. *Region pairs.* Regions that share a cell and aren't connected yet are compared by their pivots. Cells
   of ``COLD`` regions at most are joined by key, larger ones as spaces (see 6). By the triangle inequality two
   regions p, q can have a link only if d(p, q) <= r + radius(p) + radius(q).
5. *Windows.* Of such a pair, members x of p with d(x, p) >= d(p, q) - r - radius(q), and likewise of q, are
   replicated to the pair and compared with the other region's pivot. What this leaves open is a space of
   its two windows.
6. *Recursion.* A space of ``LEAF`` points at most is joined in one task. A larger one takes pivots of its
   own: every point is compared exactly with them, belongs to the region of the nearest, and is
   replicated to every region q with d(x, q) <= d(x, own) + 2 * (r + radii), beyond which the triangle
   inequality leaves no link. Each region is a space of the next level. A region that hardly shrinks (its
   points are all about as far from each other) is dealt into blocks, every two of which meet.

Before sets are fetched, pairs pass a bound of some n/3 bytes a set: counts of shingles by hash bucket, whose
bucket-wise minima add up to no less than the intersection. Only sets of surviving pairs are ever shuffled.

Links between different texts are lost nowhere: what isn't compared is already connected, or excluded by the
prefix bound, the sizes or the triangle inequality. Components come from alternating stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import KeyFilter, Scratch, load, quoted, text_of, unused
from ._text import NON_SPACE, U, Words, batches, mix, utf8
from .components import components

SHINGLE = 4
PERCENT = 85
ROUNDS = 4
#: A min-hash group beyond this size is dealt over so many groups, each with pivots of its own.
GROUP = 256
PIVOTS = 8
#: Pivots are chosen among so many classes of a group.
LOOK = 96
#: Cells of so many regions are joined by their key, which makes COLD / 2 pairs a row at most.
COLD = 64
#: A space of so many points is joined in one task.
LEAF = 2000
#: A region of a space that keeps more than this share of it is dealt into blocks.
SHRINK = 0.75
#: In the place of the parent space's points: this space was dealt to fit.
DEALT = -1
#: Members of a region, and questions to it, that meet in one task.
BLOCK = 1000
BUCKETS = 1 << 16
#: Signatures have so many bytes at most.
SIGNATURE = 1 << 14
_LOW48 = U((1 << 48) - 1)
_KEYS = [U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)]


def sets(texts: pa.Array, shingle: int, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all texts, one text after the other, and the n+1 offsets.

    With ``rank`` (of the top 16 bits), shingles are renamed so that frequent buckets sort last; renaming is
    one to one.
    """
    h, owner = Words(*utf8(texts), NON_SPACE).runs(shingle)
    if rank is not None:
        h = (rank[(h >> U(48)).astype(np.int64)] << U(48)) | (h & _LOW48)
    order = np.argsort(owner, kind="stable")
    h, edge = h[order], np.searchsorted(owner[order], np.arange(len(texts) + 1))
    parts = [np.unique(h[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    return np.concatenate([np.zeros(0, U), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def bucket_ranks(texts: DataFrame, shingle: int) -> np.ndarray:
    """The rank of each of 2**16 hash buckets by its count of distinct shingles, over all documents."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches(parts):
            total += np.bincount((sets(b.column("text"), shingle)[0] >> U(48)).astype(np.int64), minlength=BUCKETS)
        if total.any():
            yield pa.RecordBatch.from_pydict({"part": pa.array([int(total[:97].sum()) % 8], pa.int32()), "counts": pa.array([total.astype("<u4" if total.max() < 1 << 32 else "<u8").tobytes()], pa.binary())})

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in parts:
            for x in b.column("counts").to_pylist():
                total += np.frombuffer(x, "<u4" if len(x) == 4 * BUCKETS else "<u8").astype(np.int64)
        yield pa.RecordBatch.from_pydict({"part": pa.array([0], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, counts binary"
    summed = texts.mapInArrow(count, schema).repartition(8, "part").mapInArrow(add, schema)
    total = np.zeros(BUCKETS, np.int64)
    for r in summed.toLocalIterator():
        total += np.frombuffer(r["counts"], np.int64)
    rank = np.empty(BUCKETS, U)
    rank[np.argsort(total, kind="stable")] = np.arange(BUCKETS, dtype=U)
    return rank


def signature(s: np.ndarray) -> bytes:
    """Counts of a set's shingles by low hash bits, some 2 to 4 a bucket; empty if a count doesn't fit a byte."""
    m = 32
    while m * 4 < len(s) and m < SIGNATURE:
        m *= 2
    c = np.bincount((mix(s) & U(m - 1)).astype(np.int64), minlength=m)
    return b"" if len(s) and c.max() > 255 else c.astype(np.uint8).tobytes()


def most_common(a: bytes, na: int, b: bytes, nb: int) -> int:
    """No less than the size of the intersection of two sets of which only signatures and sizes are known."""
    if not a or not b:
        return min(na, nb)
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    m = min(len(x), len(y))
    x, y = (v if len(v) == m else v.reshape(-1, m).sum(0, dtype=np.int64) for v in (x, y))
    return int(np.minimum(x, y).sum(dtype=np.int64))


def _profile(rank: np.ndarray, shingle: int, percent: int):
    """By document: size, fingerprint, min-hash keys and prefix of its set."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts):
            s, o = sets(b.column("text"), shingle, rank)
            n = np.diff(o)
            some = np.flatnonzero(n)
            cols = np.zeros((5, len(n)), U)
            if len(s):
                at = o[some]
                m = mix(s)
                cols[0, some], cols[1, some] = np.add.reduceat(m, at), np.add.reduceat(mix(m ^ _KEYS[0]), at)
                for k, c in enumerate(_KEYS):
                    cols[2 + k, some] = np.minimum.reduceat(mix(s ^ c), at)
            take = np.where(n > 0, n - (n * percent + 99) // 100 + 1, 0)
            first = np.repeat(o[:-1] - np.concatenate([[0], np.cumsum(take)[:-1]]), take) + np.arange(int(take.sum()))
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]).astype(np.int32)), pa.array(s[first].view(np.int64)))
            sig = pa.array([signature(s[x:y]) for x, y in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(n), *[pa.array(c.view(np.int64)) for c in cols], prefix, sig], ["doc_id", "row", "n", "f1", "f2", "m0", "m1", "m2", "prefix", "sig"])

    return run


def _sets_of(rank: np.ndarray, shingle: int, wanted: KeyFilter):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(parts):
            keep = pa.array(np.flatnonzero(wanted.test(b.column("row").to_numpy(zero_copy_only=False).astype(np.int64))))
            if len(keep):
                b = b.take(keep)
                s, o = sets(b.column("text"), shingle, rank)
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([s[x:y].tobytes() for x, y in zip(o[:-1], o[1:], strict=True)], pa.binary())], ["row", "s"])

    return run


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[at] == a))


def _near(x: tuple[int, int, bytes], y: tuple[int, int, bytes], percent: int) -> bool:
    """Whether two classes (id, size, signature) may be within r."""
    n, m = x[1], y[1]
    if 100 * min(n, m) < percent * max(n, m):
        return False
    i = most_common(x[2], n, y[2], m)
    return 100 * i >= percent * (n + m - i)


def central(first: list[tuple[int, int, bytes]], percent: int) -> list[tuple[int, int, bytes]]:
    """Pivots from a group's first classes: again and again the one that may cover most of those left (two at least)."""
    k = len(first)
    near = np.zeros((k, k), bool)
    for i in range(k):
        for j in range(i):
            near[i, j] = near[j, i] = _near(first[i], first[j], percent)
    left, out = np.ones(k, bool), []
    while len(out) < PIVOTS:
        gain = (near & left[None, :]).sum(1) * left
        i = int(gain.argmax())
        if not gain[i]:
            break
        out.append(first[i])
        left &= ~near[i]
        left[i] = False
    return out


def _meet(percent: int):
    """Groups arrive sorted by key and salt, earlier pivots first: each class is paired with the pivots that may be within r.

    The pivots of a group are the most central of its first ``LOOK`` classes.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first, pivots, out = None, [], None, []

        def place(x: tuple[int, int, bytes]) -> None:
            out.extend((x[0], p[0]) for p in pivots if p[0] != x[0] and _near(x, p, percent))

        def settle() -> None:
            """Choose the pivots and place the classes that waited; pivots aren't placed."""
            nonlocal pivots, first
            pivots = central(first, percent)
            heads = {p[0] for p in pivots}
            for x in first:
                if x[0] not in heads:
                    place(x)
            first = []

        for b in parts:
            for key, salt, *x in zip(*(b.column(c).to_pylist() for c in ("key", "salt", "node", "n", "sig")), strict=True):
                if (key, salt) != group:
                    if pivots is None and first:
                        settle()
                    group, first, pivots = (key, salt), [], None
                if pivots is None:
                    first.append(tuple(x))
                    if len(first) == LOOK:
                        settle()
                else:
                    place(tuple(x))
            if len(out) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
                out.clear()
        if pivots is None and first:
            settle()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return run


def _may_reach(r: float):
    """Of pairs with signatures and radii those whose distance may be r + both radii at most."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            keep = []
            for sa, na, sb, nb, ra, rb in zip(*(b.column(c).to_pylist() for c in ("sig_a", "n_a", "sig_b", "n_b", "radius_a", "radius_b")), strict=True):
                i = most_common(sa, na, sb, nb)
                keep.append(1 - i / (na + nb - i) <= r + ra + rb + 1e-9)
            yield b.select(["a", "b", "radius_a", "radius_b"]).filter(pa.array(keep, pa.bool_()))

    return run


class Signatures:
    """Sizes and signatures of some points, as one table for each length of signatures."""

    def __init__(self, sizes: list[int], sigs: list[bytes]):
        self.size, self.whole = np.array(sizes, np.int64), [np.frombuffer(x, np.uint8) for x in sigs]
        width = np.array([len(x) for x in sigs], np.int64)
        self.at = {int(k): np.flatnonzero(width == k) for k in np.unique(width)}
        self.folded = {(k, k): np.stack([self.whole[i] for i in at]) for k, at in self.at.items() if k}

    def table(self, k: int, m: int) -> np.ndarray:
        """The signatures of ``k`` bytes, folded to ``m`` buckets."""
        if (k, m) not in self.folded:
            whole = self.folded[k, k]
            self.folded[k, m] = np.concatenate([whole[a : a + 64].reshape(-1, k // m, m).sum(1, dtype=np.uint32) for a in range(0, len(whole), 64)])
        return self.folded[k, m]

    def distances(self, size: int, sig: np.ndarray, coarse: int = SIGNATURE) -> np.ndarray:
        """By point: no more than its Jaccard distance to a set of this size and signature; by ``coarse`` buckets at most."""
        i = np.minimum(self.size, size)
        for k, at in self.at.items():
            m = min(k, len(sig), coarse)
            if m:
                x, y = self.table(k, m), sig.reshape(-1, m).sum(0, dtype=np.uint32)
                i[at] = np.concatenate([np.minimum(x[a : a + 256], y).sum(1, dtype=np.int64) for a in range(0, len(x), 256)])
        return 1 - i / (self.size + size - i)

    def distance(self, i: int, j: int) -> float:
        """No more than the Jaccard distance of two of the points, by their whole signatures."""
        n, m = int(self.size[i]), int(self.size[j])
        common_ = most_common(self.whole[i].tobytes(), n, self.whole[j].tobytes(), m)
        return 1 - common_ / (n + m - common_)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)


def _look(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by region, block and kind. Members (kind 0: distance from their pivot in ``low``) are gathered, ``BLOCK`` at
    most; each question (kind 1) asks for those with distances from ``low`` on that may be within ``high`` of its set."""
    block, sizes, sigs, ids, far, table, out = None, [], [], [], [], None, []
    for b in parts:
        for region, part, kind, node, n, sig, low, high in zip(*(b.column(c).to_pylist() for c in ("region", "block", "kind", "node", "n", "sig", "low", "high")), strict=True):
            if (region, part) != block:
                block, sizes, sigs, ids, far, table = (region, part), [], [], [], [], None
            if not kind:
                sizes.append(n), sigs.append(sig), ids.append(node), far.append(low)
            elif ids:
                table = table or (Signatures(sizes, sigs), np.array(far))
                near = np.flatnonzero((table[1] >= low) & (table[0].distances(n, np.frombuffer(sig, np.uint8)) <= high))
                out += [(ids[i], node, region) for i in near.tolist() if ids[i] != node]
        if len(out) > 100_000:
            yield _batch(out, ["node", "other", "region"])
            out.clear()
    if out:
        yield _batch(out, ["node", "other", "region"])


def _leaf(r: float):
    """Points of small spaces, sorted by space: pairs (a, b) that may be within r and both radii of each other, of
    different components and (where a space has sides) of different sides."""

    def pairs(points: list[tuple]) -> list[tuple[int, int]]:
        node, component, side, sizes, radius, sigs = zip(*points, strict=True)
        node, component, side, radius = np.array(node), np.array(component), np.array(side), np.array(radius)
        table, out = Signatures(sizes, sigs), []
        for i in range(len(node)):
            reach = r + radius[i] + radius + 1e-9
            # A coarse look at all points, a full one at those that it leaves.
            near = (component != component[i]) & ((side != side[i]) | (side == 0)) & (node > node[i])
            if near.any():
                near &= table.distances(int(table.size[i]), table.whole[i], 64) <= reach
                out += [(int(node[i]), int(node[j])) for j in np.flatnonzero(near).tolist() if table.distance(i, j) <= reach[j]]
        return out

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, points, out = None, [], []
        for b in parts:
            for key, *x in zip(*(b.column(c).to_pylist() for c in ("space", "node", "component", "side", "n", "radius", "sig")), strict=True):
                if key != space:
                    out += pairs(points) if len(points) > 1 else []
                    space, points = key, []
                    if len(out) > 100_000:
                        yield _batch(out, ["a", "b"])
                        out = []
                points.append(tuple(x))
        out += pairs(points) if len(points) > 1 else []
        if out:
            yield _batch(out, ["a", "b"])

    return run


def _compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the intersection's size, and the sizes, to rows with two sets."""
    for b in parts:
        left, right = (b.column(c).to_pylist() for c in ("sa", "sb"))
        x = [(common(u, v), len(u), len(v)) for u, v in ((np.frombuffer(p, U), np.frombuffer(q, U)) for p, q in zip(left, right, strict=True))]
        keep = [c for c in b.schema.names if c not in ("sa", "sb")]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *[pa.array(v, pa.int64()) for v in (zip(*x, strict=True) if x else ([], [], []))]], [*keep, "i", "na", "nb"])


class Join:
    """The steps of the join over one table; see the module's text. Nodes of the graph are classes, numbered when they are written."""

    def __init__(self, docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str):
        self.shingle, self.percent = shingle, percent
        self.r = 1 - percent / 100
        self.work = Scratch(docs.sparkSession, "jaccard")
        #: A row's key: rows of one key repeat id and text.
        self.docs = text_of(docs, id_col, text_col).withColumn("row", row_key())
        self.id_type = self.docs.schema["doc_id"].dataType.simpleString()

    def linked(self) -> Column:
        return F.lit(100) * F.col("i") >= F.lit(self.percent) * (F.col("na") + F.col("nb") - F.col("i"))

    def compared(self, pairs: DataFrame, name: str) -> DataFrame:
        """Pairs (a, b, ...) with d = 1 - Jaccard and whether they link, written to the shared folder."""
        pairs = self.work.keep(pairs, f"{name}-pairs")
        ids = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = self.work.keep(self.active.select("node", "row").join(ids, "node", "left_semi"), f"{name}-wanted")
        found = self.docs.select("text", "row").mapInArrow(_sets_of(self.rank, self.shingle, KeyFilter(wanted, "row")), "row long, s binary")
        # Rows that repeat id and text have the same set.
        s = found.join(wanted, "row").groupBy("node").agg(F.first("s").alias("s"))
        both = pairs.join(s.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.schema if f.name not in ("sa", "sb"))
        out = both.mapInArrow(_compare, f"{kinds}, i long, na long, nb long")
        out = self.work.keep(out.select("*", (1 - F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).alias("d"), self.linked().alias("link")), name)
        self.work.drop(f"{name}-pairs", f"{name}-wanted")
        return out

    def solve(self) -> tuple[DataFrame, DataFrame]:
        """(profile, named): rows with the fingerprint of their sets (f1, f2, n; n is 0 without shingles), and by fingerprint the
        component's number, its smallest doc_id, and whether (keeper) a row is the one that stands for the component."""
        work = self.work
        self.rank = bucket_ranks(self.docs.select("text"), self.shingle)
        profile = work.keep(self.docs.mapInArrow(_profile(self.rank, self.shingle, self.percent), f"doc_id {self.id_type}, row long, n long, f1 long, f2 long, m0 long, m1 long, m2 long, prefix array<long>, sig binary"), "profile")
        # The first row of a class is that of the smallest id; rows without id come last.
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
        classes = profile.where("n > 0").groupBy("f1", "f2", "n").agg(first, *[F.first(c).alias(c) for c in ("m0", "m1", "m2", "prefix", "sig")])
        classes = work.keep(classes.select(F.monotonically_increasing_id().alias("node"), F.col("first.row").alias("row"), "*"), "classes")
        cells = classes.select("node", F.explode("prefix").alias("cell"))
        shared = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("cell")
        self.cells = work.keep(cells.join(shared.hint("merge"), "cell").select("cell", "node"), "cells")
        self.active = work.keep(self.cells.select("node").distinct().join(classes.select("node", "row", "n", "m0", "m1", "m2", "sig"), "node"), "active")
        labels = self._labels()
        named = classes.select("f1", "f2", "n", "node", "first")
        if labels is not None:
            named = named.join(labels.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        else:
            named = named.withColumn("component", F.col("node"))
        named = work.keep(named, "named")
        least = named.groupBy("component").agg(F.min("first").alias("least"))
        named = work.keep(named.join(least, "component").select("f1", "f2", "n", "component", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("keeper")), "components")
        work.drop("classes", "cells", "active", "named", "region", "covered", *[f"left-{k}" for k in range(ROUNDS)], *[f"round-{k}" for k in range(ROUNDS)])
        return profile.select("doc_id", "row", "n", "f1", "f2"), named

    def run(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every row."""
        profile, named = self.solve()
        linked = profile.where("n > 0").join(named.hint("merge"), ["f1", "f2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
        rest = profile.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        out = self.work.keep(linked.union(rest), "result")
        self.work.drop("profile", "components")
        return out

    def _labels(self) -> DataFrame | None:
        """Components of the active classes; None if there is none."""
        work, active = self.work, self.active
        if active.isEmpty():
            return None
        met = self._regions()
        if met.isEmpty():
            covered = met.selectExpr("a AS node", "b AS pivot", "0D AS d")
        else:
            covered = self.compared(met, "covered").where("link").select(F.col("a").alias("node"), F.col("b").alias("pivot"), "d")
        links = covered.select(F.col("node").alias("a"), F.col("pivot").alias("b"))
        labels = components(links, work, "after-regions")
        # Every class's region: its nearest pivot, or itself.
        near = covered.groupBy("node").agg(F.min_by("pivot", F.struct("d", "pivot")).alias("pivot"), F.min("d").alias("d"))
        region = active.select("node", "n").join(near, "node", "left").join(labels.withColumnRenamed("id", "node"), "node", "left")
        pivots = covered.select(F.col("pivot").alias("node")).distinct().withColumn("heads", F.lit(True))
        # A pivot heads its own region, also if another pivot covered it later.
        region = region.join(pivots, "node", "left").select(
            "node", "n", F.when(F.col("heads"), F.col("node")).otherwise(F.coalesce("pivot", "node")).alias("region"),
            F.when(F.col("heads"), 0.0).otherwise(F.coalesce("d", F.lit(0.0))).alias("d"), F.coalesce("component", "node").alias("component"),
        )
        region = work.keep(region, "region")
        met = work.keep(self._met(region), "met")
        if met.isEmpty():
            return labels
        decided = self.compared(met, "decided")
        more = decided.where("link").select("a", "b")
        edge = decided.where(~F.col("link") & (F.col("radius_a") + F.col("radius_b") > 0) & (F.col("d") <= self.r + F.col("radius_a") + F.col("radius_b") + 1e-9))
        if more.isEmpty() and edge.isEmpty():
            return labels
        all_links = links.union(more)
        labels = components(all_links, work, "after-pivots")
        edge = work.keep(self._open(edge.select("a", "b", "d", "radius_a", "radius_b"), labels), "edge")
        if not edge.isEmpty():
            labels = self._windows(region, edge, all_links, labels)
        return labels

    def _regions(self) -> DataFrame:
        """(a, b): classes and the pivots that may cover them, from rounds over different min-hashes."""
        work, left = self.work, self.active.drop("row").withColumn("pivot", F.lit(False))
        out = None
        for k in range(ROUNDS):
            keyed = left.select("node", F.col(f"m{k % 3}").alias("key"), "pivot", "n", "sig")
            groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key", F.ceil(F.col("k") / GROUP).cast("int").alias("salts"))
            salt = F.when(F.col("salts") > 1, F.pmod(F.xxhash64("node", F.lit(-k)), F.col("salts"))).otherwise(F.lit(0)).cast("long")
            dealt = keyed.join(groups, "key").select("key", salt.alias("salt"), (~F.col("pivot")).cast("int").alias("late"), "node", "n", "sig")
            pairs = dealt.repartition("key", "salt").sortWithinPartitions("key", "salt", "late", F.xxhash64("node", F.lit(k))).select("key", "salt", "node", "n", "sig").mapInArrow(_meet(self.percent), "a long, b long")
            now = work.keep(pairs, f"round-{k}")
            out = now if out is None else out.union(now)
            if k + 1 < ROUNDS:
                gone, heads = now.select(F.col("a").alias("node")).distinct(), out.select(F.col("b").alias("node")).distinct().withColumn("is_pivot", F.lit(True))
                rest = left.drop("pivot").join(gone, "node", "left_anti").join(heads, "node", "left")
                left = work.keep(rest.withColumn("pivot", F.coalesce("is_pivot", F.lit(False))).drop("is_pivot"), f"left-{k}")
        return out.distinct()

    def _met(self, region: DataFrame) -> DataFrame:
        """Pairs (a, b) of unconnected regions that share a cell and may match, with their radii."""
        sizes = region.groupBy("region").agg(F.max("d").alias("radius"))
        rows = self.cells.join(region.select("node", "n", "region", "component"), "node")
        rows = rows.groupBy("cell", "region").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.first("component").alias("component"))
        mixed = rows.groupBy("cell").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("k")).where("x <> y").select("cell", "k")
        rows = self.work.keep(rows.join(mixed.hint("merge"), "cell").join(sizes, "region"), "cell-regions")
        cold = rows.where(F.col("k") <= COLD)
        a, b = (cold.select("cell", *[F.col(c).alias(f"{c}_{s}") for c in ("region", "lo", "hi", "component")]) for s in "ab")
        fits = (F.col("hi_a") * 100 >= F.col("lo_b") * self.percent) & (F.col("hi_b") * 100 >= F.col("lo_a") * self.percent)
        pairs = a.hint("merge").join(b.hint("merge"), "cell").where((F.col("region_a") < F.col("region_b")) & (F.col("component_a") != F.col("component_b")) & fits)
        pairs = pairs.select(F.col("region_a").alias("a"), F.col("region_b").alias("b")).distinct()
        signed = self.active.join(sizes, self.active["node"] == sizes["region"]).select("node", "n", "sig", "radius")
        for c in "ab":
            pairs = pairs.join(signed.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "sig", "radius")]), c)
        pairs = pairs.mapInArrow(_may_reach(self.r), "a long, b long, radius_a double, radius_b double")
        hot = rows.where(F.col("k") > COLD).select(F.col("cell").alias("space"), F.col("region").alias("node"), "component", F.lit(0).alias("side")).join(signed, "node")
        more = self._spaces(hot, "cells")
        if more is not None:
            for c in "ab":
                more = more.join(sizes.select(F.col("region").alias(c), F.col("radius").alias(f"radius_{c}")), c)
            pairs = pairs.union(more.select("a", "b", "radius_a", "radius_b")).distinct()
        return pairs

    def _spaces(self, points: DataFrame, name: str) -> DataFrame | None:
        """(a, b): pairs of points of one space that may hold a link; None without points.

        ``points`` has space, node, component, side (0: none), n, sig, radius. Levels of pivots, regions and windows go on
        until every space fits one task.
        """
        work, out, level = self.work, None, 0
        points = work.keep(points.select("space", "node", "component", "side", "n", "sig", "radius", F.lit(None).cast("long").alias("parent")), f"{name}-points")
        while not points.isEmpty():
            sizes = points.groupBy("space").agg(F.count(F.lit(1)).alias("k"), F.max("radius").alias("widest"))
            sized = points.join(sizes, "space")
            fits = (F.col("k") <= LEAF) | F.coalesce(F.col("parent") == DEALT, F.lit(False))
            small = sized.where(fits).repartition("space").sortWithinPartitions("space")
            found = work.keep(small.select("space", "node", "component", "side", "n", "radius", "sig").mapInArrow(_leaf(self.r), "a long, b long").distinct(), f"{name}-found-{level}")
            out = found if out is None else out.union(found)
            large = work.keep(sized.where(~fits), f"{name}-large-{level}")
            work.drop(f"{name}-points" if not level else f"{name}-points-{level}")
            level += 1
            stuck = F.coalesce(F.col("k") > SHRINK * F.col("parent"), F.lit(False))
            points = work.keep(self._blocks(large.where(stuck)).unionByName(self._split(large.where(~stuck), f"{name}-{level}")), f"{name}-points-{level}")
        return out

    def _split(self, points: DataFrame, name: str) -> DataFrame:
        """The next level's spaces: Voronoi regions of pivots of each space, with the points of their windows."""
        if points.isEmpty():
            return points.drop("k", "widest").limit(0)
        chosen = points.groupBy("space").agg(F.array_distinct(F.array(*[F.min_by("node", F.xxhash64("node", F.lit(f"{name}-{j}"))) for j in range(PIVOTS)])).alias("pivots"))
        asked = points.select("space", "node").join(chosen, "space").select("space", F.col("node").alias("a"), F.explode("pivots").alias("b"))
        far = self.compared(asked.select("a", "b").distinct(), name).select("a", "b", "d")
        far = asked.join(far, ["a", "b"])
        nearest = far.groupBy("space", "a").agg(F.min("d").alias("own"))
        placed = far.join(nearest, ["space", "a"]).join(points.withColumnRenamed("node", "a"), ["space", "a"])
        # A link of x reaches no further than r, its own radius and the widest other; twice that is the window.
        inside = F.col("d") <= F.col("own") + 2 * (F.lit(self.r) + F.col("radius") + F.col("widest")) + 1e-9
        return placed.where(inside).select(F.xxhash64("space", "b", F.lit(name)).alias("space"), F.col("a").alias("node"), "component", "side", "n", "sig", "radius", F.col("k").alias("parent"))

    def _blocks(self, points: DataFrame) -> DataFrame:
        """The next level's spaces, which fit one task: every two blocks of each space, dealt by hash."""
        count = F.ceil(F.col("k") * 2.5 / LEAF).cast("int")
        dealt = points.withColumn("blocks", count).withColumn("mine", F.pmod(F.xxhash64("node", "k"), F.col("blocks")).cast("int"))
        met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return met.select(F.xxhash64("space", F.least("mine", "other"), F.greatest("mine", "other"), F.lit("block")).alias("space"), "node", "component", "side", "n", "sig", "radius", F.lit(DEALT).cast("long").alias("parent"))

    def _open(self, pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs whose ends aren't connected yet."""
        for c in "ab":
            pairs = pairs.join(labels.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")), c, "left")
        return pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")

    def _windows(self, region: DataFrame, edge: DataFrame, links: DataFrame, labels: DataFrame) -> DataFrame:
        """Member level: each window against the other pivot, then window against window for what stays open."""
        work, active = self.work, self.active
        members = region.select("node", "region", F.col("d").alias("dm"), "n").where("node <> region").join(active.select("node", "sig"), "node")
        pairs = None
        for mine, other in (("a", "b"), ("b", "a")):
            asked = edge.join(active.select(F.col("node").alias(other), "n", "sig"), other)
            asked = asked.select(F.col(mine).alias("region"), F.col(other).alias("node"), "n", "sig", (F.col("d") - self.r - F.col(f"radius_{other}") - 1e-9).alias("low"), (F.col(f"radius_{other}") + self.r + 1e-9).alias("high"))
            near = work.keep(self._asked(members, work.keep(asked, f"asked-{mine}")), f"near-{mine}")
            work.drop(f"asked-{mine}")
            ends = (F.col("region").alias("pa"), F.col("other").alias("pb")) if mine == "a" else (F.col("other").alias("pa"), F.col("region").alias("pb"))
            side = near.select(*ends, F.col("node").alias("a"), F.col("other").alias("b"), F.lit(1 if mine == "a" else 2).alias("side"))
            pairs = side if pairs is None else pairs.union(side)
        first = self.compared(pairs, "window-pivots")
        links = links.union(first.where("link").select("a", "b"))
        labels = components(links, work, "after-windows")
        still = work.keep(self._open(edge, labels).select(F.col("a").alias("pa"), F.col("b").alias("pb"), "radius_a", "radius_b"), "still")
        if still.isEmpty():
            return labels
        # Members of both windows, within reach of the other pivot; both sides together are one space.
        reach = self.r + F.when(F.col("side") == 1, F.col("radius_b")).otherwise(F.col("radius_a")) + 1e-9
        known = first.join(still, ["pa", "pb"]).where(F.col("d") <= reach).select("pa", "pb", "side", F.col("a").alias("node"))
        both = known.groupBy("pa", "pb").agg(F.min("side").alias("x"), F.max("side").alias("y")).where("x < y").select("pa", "pb")
        points = known.join(both, ["pa", "pb"]).join(active.select("node", "n", "sig"), "node").join(labels.withColumnRenamed("id", "node"), "node", "left")
        points = points.select(F.xxhash64("pa", "pb").alias("space"), "node", F.coalesce("component", "node").alias("component"), "side", "n", "sig", F.lit(0.0).alias("radius"))
        pairs = self._spaces(points, "windows")
        if pairs is None:
            return labels
        last = self.compared(pairs.distinct(), "window-members")
        return components(links.union(last.where("link").select("a", "b")), work, "after-members")

    def _asked(self, members: DataFrame, asked: DataFrame) -> DataFrame:
        """(node, other, region): members of the asked regions that may be in the window; blocks of members meet blocks of questions."""
        count = lambda df, name: df.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
        blocks = count(members, "rows").join(count(asked, "columns"), "region")
        dealt = []
        for df, mine, other, kind in ((members.withColumn("low", F.col("dm")).withColumn("high", F.lit(0.0)), "rows", "columns", 0), (asked, "columns", "rows", 1)):
            put = df.join(blocks, "region").withColumn("there", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).withColumn("here", F.pmod(F.xxhash64("node"), F.col(mine)).cast("int"))
            row, column = ("here", "there") if kind == 0 else ("there", "here")
            dealt.append(put.select("region", (F.col(row) * F.col("columns") + F.col(column)).alias("block"), F.lit(kind).alias("kind"), "node", "n", "sig", "low", "high"))
        return dealt[0].union(dealt[1]).repartition("region", "block").sortWithinPartitions("region", "block", "kind").mapInArrow(_look, "node long, other long, region long")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A hash of a row's id and text."""
    return F.xxhash64(id_col, F.col(text_col).cast("string"))


def jaccard_join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Words are what ASCII white space separates, A-Z lower-cased; a set has the distinct ``shingle``-word
    runs, a shorter text its whole sequence. Two sets link when 100 * |A and B| >= percent * |A or B|.

    Defined cases: null, empty and wordless texts have no shingles and link with nothing; very long texts are
    one set each; rows with a null doc_id have a null component, their texts link others; rows that repeat a doc_id with other texts are
    documents of their own; repeated rows share a component; columns of any other name are not looked at; an
    empty table gives no rows.
    """
    return Join(docs, shingle, percent, id_col, text_col).run()


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: of each component the row of the smallest doc_id stays.

    Defined cases: as above; rows without id stay only where their component has no row with one; rows without
    words stay; rows that repeat id and text stay or go together.
    """
    join = Join(docs, shingle, percent, id_col, text_col)
    profile, named = join.solve()
    gone = profile.where("n > 0").join(named.hint("merge"), ["f1", "f2", "n"]).where("row <> keeper").select("row").distinct()
    row = unused(docs, "row")[0]
    gone = join.work.keep(gone.withColumnRenamed("row", row), "gone")
    join.work.drop("profile", "components")
    return docs.withColumn(row, row_key(id_col, text_col)).join(gone, row, "left_anti").select(*map(quoted, docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(load(spark, sf_dir, "documents"))
