"""Approximate nearest neighbours by inner product: a forest of random-projection trees, one shared priority queue, exact reranking.

Vectors get one more component that makes them all of one length, so the largest inner product is the smallest angle. Trees split at
the median along the difference of two random members of a bounded sample; every vector is put in one leaf of each tree. A query
descends all trees from one priority queue, nearest splits first, and takes the first `visits` leaves, whichever trees they are of.
`visits` is measured: on the sample, against brute force, so that the target recall is reached with the trees at hand.

Leaves that lie side by side are dealt to one part. A query is sent to each part once, with its leaves there; the part scores its
leaves' vectors in double precision and returns its best k. Of copies of one vector only the k + 1 least ids can be among a query's
k nearest (ties go to the least id); the others are left out as candidates beforehand, which changes no result and keeps leaves even.

Defined results: vectors that are null, zero, of another length than most of the sample, or hold null or non-finite components take no
part, as queries or candidates; rows of one vec_id count once; fewer candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import one_to_one

#: Most vectors that trees are fitted to and recall is measured on: those of least hash of their id.
SAMPLE_ROWS = 16_384
TREES = 8
#: Vectors aimed at in a leaf.
LEAF_ROWS = 200
#: Share of true neighbours that `visits` must reach on the sample.
TARGET_RECALL = 0.96
#: Queries on which it is measured.
TRIAL_QUERIES = 200
#: Bytes of vectors aimed at in a part.
PART_BYTES = 32 << 20


class Forest:
    """Complete binary trees of one depth. normals: trees x splits x (dim + 1); a split's children are 2i + 1 and 2i + 2."""

    def __init__(self, sample: np.ndarray, longest: float, depth: int, trees: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.depth, self.longest = depth, longest
        x = self.lift(sample)
        splits = (1 << depth) - 1
        self.normals = np.zeros((trees, splits, x.shape[1]), np.float32)
        self.cuts = np.zeros((trees, splits), np.float32)
        for t in range(trees):
            node = np.zeros(len(x), np.int64)
            for level in range(depth):
                for i in range((1 << level) - 1, (2 << level) - 1):
                    rows = np.flatnonzero(node == i)
                    if len(rows) >= 2:
                        a, b = rng.choice(rows, 2, replace=False)
                        normal = x[a] - x[b]
                    if len(rows) < 2 or not normal.any():
                        normal = rng.normal(size=x.shape[1])
                    normal = normal / np.linalg.norm(normal)
                    along = x[rows] @ normal
                    self.normals[t, i], self.cuts[t, i] = normal, np.median(along) if len(rows) else 0.0
                    node[rows] = 2 * i + 1 + (along > self.cuts[t, i])
        self.leaves = trees << depth

    def lift(self, x: np.ndarray) -> np.ndarray:
        """One component more, so that all lengths are 1; longest: the greatest length there is."""
        x = x.astype(np.float64) / self.longest
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))], axis=1)

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree (rows x trees), numbered through all trees."""
        x, out = self.lift(x).astype(np.float32), np.zeros((len(x), len(self.normals)), np.int64)
        for t, (normals, cuts) in enumerate(zip(self.normals, self.cuts, strict=True)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, normals[node]) > cuts[node])
            out[:, t] = node - len(cuts) + (t << self.depth)
        return out

    def search(self, queries: np.ndarray, visits: int) -> list[list[int]]:
        """For each query the first `visits` leaves off the queue that all trees share: by the least distance to a split that was crossed."""
        q = np.concatenate([queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-300), np.zeros((len(queries), 1))], axis=1).astype(np.float32)
        splits = self.cuts.shape[1]
        out = []
        for row in q:
            margins = (self.normals @ row - self.cuts).tolist()
            queue = [(0.0, t, 0) for t in range(len(margins))]
            found: list[int] = []
            while queue and len(found) < visits:
                crossed, t, node = heapq.heappop(queue)
                own = margins[t]
                while node < splits:
                    m = own[node]
                    near = 2 * node + 1 + (m > 0)
                    heapq.heappush(queue, (max(crossed, abs(m)), t, 4 * node + 3 - near))
                    node = near
                found.append(node - splits + (t << self.depth))
            out.append(found)
        return out


def needed_visits(forest: Forest, sample: np.ndarray, k: int, target: float, trials: int) -> int:
    """Leaves to visit so that `target` of the sample's true neighbours of its first rows are met."""
    leaves = forest.place(sample)
    wanted = []
    orders = forest.search(sample[:trials], forest.leaves)
    for i, order in enumerate(orders):
        rank = np.empty(forest.leaves, np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        score = sample.astype(np.float64) @ sample[i].astype(np.float64)
        score[i] = -np.inf
        best = np.argsort(-score, kind="stable")[: min(k, len(sample) - 1)]
        wanted.append(rank[leaves[best]].min(axis=1))
    every = np.sort(np.concatenate(wanted)) if wanted else np.zeros(0, np.int64)
    return int(every[min(len(every) - 1, int(np.ceil(target * len(every))))]) if len(every) else 1


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best by score, then least id; one of each id."""
    order = np.lexsort((ids, -scores, query))
    q, v = query[order], ids[order]
    first = np.ones(len(q), bool)
    first[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])  # copies of a pair have one score and stand side by side
    order, q = order[first], q[first]
    starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    nth = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    return order[nth < k]


def _score_part(batches, k: int, dim: int):
    """Rows (part, kind, leaf, leaves, id, vec), vectors before queries, to (query_id, vec_id, score)."""
    ids_of: dict[int, list] = {}
    vectors: dict[int, list] = {}
    ready: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        kind = batch.column(1).to_numpy(zero_copy_only=False)
        vec = batch.column(5).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        ids = batch.column(4).to_numpy(zero_copy_only=False)
        leaf = batch.column(2).to_numpy(zero_copy_only=False)
        own = np.flatnonzero(kind == 0)
        if len(own):
            order = own[np.argsort(leaf[own], kind="stable")]
            for rows in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
                ids_of.setdefault(int(leaf[rows[0]]), []).append(ids[rows])
                vectors.setdefault(int(leaf[rows[0]]), []).append(vec[rows])
        asking = np.flatnonzero(kind == 1)
        if not len(asking):
            continue
        if not ready:
            ready = {x: (np.concatenate(ids_of[x]), np.concatenate(vectors[x]).astype(np.float64)) for x in ids_of}
            ids_of, vectors = {}, {}
        lists = batch.column(3).to_pylist()
        for at in range(0, len(asking), 256):
            some = asking[at : at + 256]
            q = vec[some].astype(np.float64)
            who: dict[int, list[int]] = {}
            for i, row in enumerate(some.tolist()):
                for x in lists[row]:
                    if x in ready:
                        who.setdefault(x, []).append(i)
            got_q, got_id, got_s = [], [], []
            for x, rows in who.items():
                names, m = ready[x]
                s = q[rows] @ m.T
                keep = s >= np.partition(s, len(names) - k - 1, axis=1)[:, [len(names) - k - 1]] - 1e-9 * (1 + np.abs(s).max()) if len(names) > k + 1 else np.ones(s.shape, bool)
                i, j = np.nonzero(keep)
                at_q = np.array(rows)[i]
                exact = (q[at_q] * m[j]).sum(axis=1)  # summed alike wherever the vector stands
                got_q.append(at_q)
                got_id.append(names[j])
                got_s.append(exact)
            if got_q:
                a, b, c = (np.concatenate(z) for z in (got_q, got_id, got_s))
                other = b != ids[some][a]
                a, b, c = a[other], b[other], c[other]
                keep = _best(a, b, c, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some][a[keep]]), pa.array(b[keep]), pa.array(c[keep])], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, leaf_rows: int = LEAF_ROWS, target: float = TARGET_RECALL) -> DataFrame:
    """(query_id long, rank int, vec_id long, score double): each query's k nearest found by inner product. is_query: a condition on the id."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    v = F.col("vec")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("vec").toPandas()["vec"].tolist()
    if not drawn:
        return empty
    sizes = [len(x) for x in drawn]
    dim = max(sorted(set(sizes)), key=sizes.count)
    rows = rows.where(F.size(v) == dim)
    n, longest = rows.agg(F.count("*"), F.max(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))).first()
    sample = np.array([x for x in drawn if len(x) == dim], np.float64)
    depth = int(min(np.log2(max(len(sample) / 4, 1)), max(0, np.ceil(np.log2(max(n, 1) / leaf_rows)))))
    forest = Forest(sample, float(np.sqrt(longest)), depth, trees)
    visits = needed_visits(forest, sample, k, target, TRIAL_QUERIES)
    parts = max(1, min(forest.leaves, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * trees * dim * 8 // PART_BYTES)))
    shared = spark.sparkContext.broadcast(forest)  # bounded by the sample: trees x SAMPLE_ROWS / 4 splits

    keys = one_to_one(parts)  # a task for each part

    def part_of(leaf: np.ndarray) -> np.ndarray:
        return keys[leaf * parts // shared.value.leaves]

    names = ["part", "kind", "leaf", "leaves", "id", "vec"]

    def batch_of(part, kind, leaf, leaves, ids, vec):
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, vec.size + 1, dim).astype(np.int32)), pa.array(vec.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(np.full(len(ids), kind, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(leaves, pa.list_(pa.int32())), pa.array(ids), flat], names)

    def read(batch):
        return batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def place(batches):
        for batch in batches:
            every, all_ = read(batch)
            for at in range(0, len(every), 4096):
                ids, vec = every[at : at + 4096], all_[at : at + 4096]
                leaf = shared.value.place(vec)
                yield batch_of(part_of(leaf).ravel(), 0, leaf.ravel(), [[]] * leaf.size, np.repeat(ids, leaf.shape[1]), np.repeat(vec, leaf.shape[1], axis=0))

    def ask(batches):
        for batch in batches:
            every, all_ = read(batch)
            for at in range(0, len(every), 512):
                ids, vec = every[at : at + 512], all_[at : at + 512]
                part, lists, row = [], [], []
                for i, leaves in enumerate(shared.value.search(vec, visits)):
                    leaves = np.sort(np.array(leaves))
                    p = part_of(leaves)
                    for some in np.split(np.arange(len(leaves)), np.flatnonzero(np.diff(p)) + 1):
                        part.append(int(p[some[0]]))
                        lists.append(leaves[some].tolist())
                        row.append(i)
                yield batch_of(np.array(part), 1, np.full(len(row), -1), lists, ids[row], vec[row])

    schema = "part int, kind int, leaf int, leaves array<int>, id long, vec array<double>"
    alike = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    candidates = rows.withColumn("nth", alike).where(F.col("nth") <= k + 1).select("id", "vec")
    placed = candidates.mapInArrow(place, schema)
    asked = rows.where(is_query(F.col("id"))).mapInArrow(ask, schema)
    found = placed.union(asked).repartition(parts, "part").sortWithinPartitions("kind").mapInArrow(lambda it: _score_part(it, k, dim), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
