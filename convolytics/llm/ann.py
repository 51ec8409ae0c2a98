"""Approximate nearest neighbours by a forest of random-projection trees.

Equal vectors are joined into one first; only the k + 1 smallest ids of each can be among k nearest, so nothing is
lost and a vector with very many copies costs no more than another. The trees are fitted on a bounded sample
(sample_rows) of the distinct vectors and sent to the tasks; all vectors are put into a leaf of each tree. A leaf holds
about leaf_rows rows of the table while the table has up to sample_rows * leaf_rows / LEAST_LEAF vectors; beyond that the
sample bounds the number of leaves and they grow.

A query goes down all trees at once with one shared priority queue, ordered by the largest margin that was crossed on the
way, and takes leaves until the queue's least margin is over the threshold. The threshold is measured: for up to
`calibration` of the queries the nearest rows are found by brute force, and the threshold is the margin at which the
share `recall` of these neighbours stands in a leaf that is taken. So data with structure are searched in few leaves,
and data without any in as many as that recall costs.

Rows and queries meet by leaf in blocks of bounded size; there the distances are computed in double precision. Only rows
within the query's distance to its k + 1 nearest of a part of the sample are passed on (a bound that loses nothing); the
last step merges these and puts the ids back.

Vectors that are null, zero, hold null or non-finite components or have another length than most take no part, nor do
rows with a null id. Rows that repeat an id and its vector count once for each row; other columns of the tables are left
out, whatever their names. Ties go to the smaller id. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convolytics.llm.common import materialize

ROWS_PER_BLOCK, QUERIES_PER_BLOCK, SLACK = 4096, 512, 8
LEAST_LEAF, BOUND_ROWS, _SAMPLE_SPACE = 4, 4096, 1 << 20


@dataclass
class Tree:
    """Nodes by number; below 0: the leaf -1 - number."""

    normals: list[np.ndarray] = field(default_factory=list)
    offsets: list[float] = field(default_factory=list)
    children: list[tuple[int, int]] = field(default_factory=list)
    leaves: int = 0

    def grow(self, x: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> int:
        if len(x) <= leaf_rows:
            self.leaves += 1
            return -self.leaves
        a, b = x[rng.choice(len(x), 2, replace=False)]
        normal = a - b
        side = x @ normal
        offset = float(normal @ (a + b) / 2)
        if not 0.2 < (side > offset).mean() < 0.8:
            offset = float(np.median(side))
        right = side > offset
        if right.all() or not right.any():
            right = rng.random(len(x)) < 0.5
            if right.all() or not right.any():
                self.leaves += 1
                return -self.leaves
        at, norm = len(self.normals), float(np.linalg.norm(normal)) or 1.0
        self.normals.append(normal / norm)
        self.offsets.append(offset / norm)
        self.children.append((0, 0))
        self.children[at] = (self.grow(x[~right], leaf_rows, rng), self.grow(x[right], leaf_rows, rng))
        return at

    def freeze(self) -> None:
        self.n, self.o = np.array(self.normals, np.float32), np.array(self.offsets, np.float32)
        self.c = np.array(self.children, np.int32).reshape(-1, 2)
        self.normals, self.offsets, self.children = [], [], []

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64) if len(self.n) else np.full(len(x), -1, np.int64)
        while (inner := np.flatnonzero(node >= 0)).size:
            at = node[inner]
            right = np.einsum("ij,ij->i", x[inner], self.n[at]) - self.o[at] > 0
            node[inner] = self.c[at, right.astype(np.int64)]
        return -1 - node


    def crossed(self, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        """For each pair of rows of q and v: the largest margin that a search for q crosses on its way to v's leaf."""
        worst = np.full(len(v), -math.inf)
        node = np.zeros(len(v), np.int64) if len(self.n) else np.full(len(v), -1, np.int64)
        while (inner := np.flatnonzero(node >= 0)).size:
            at = node[inner]
            of_q, of_v = (np.einsum("ij,ij->i", x[inner], self.n[at]) - self.o[at] for x in (q, v))
            worst[inner] = np.maximum(worst[inner], np.where((of_q > 0) != (of_v > 0), np.abs(of_q), -math.inf))
            node[inner] = self.c[at, (of_v > 0).astype(np.int64)]
        return worst


def search(trees: list[Tree], q: np.ndarray, threshold: float) -> np.ndarray:
    """The leaves (tree << 32 | leaf) that a query takes, nearest first, by one priority queue for all trees."""
    margins = [(t.n @ q - t.o).tolist() if len(t.n) else [] for t in trees]
    children = [t.c for t in trees]
    queue = [(-math.inf, i, 0 if len(t.n) else -1) for i, t in enumerate(trees)]
    found = []
    while queue:
        worst, i, node = heapq.heappop(queue)
        if worst > threshold:
            break
        while node >= 0:
            m = margins[i][node]
            low, high = children[i][node].tolist()
            near, far = (high, low) if m > 0 else (low, high)
            if (far_worst := max(worst, abs(m))) <= threshold:
                heapq.heappush(queue, (far_worst, i, far))
            node = near
        found.append(i << 32 | (-1 - node))
    return np.array(found, np.int64)


def fit(sample: np.ndarray, n_trees: int, leaf_rows: int, seed: int = 7) -> list[Tree]:
    trees = []
    for i in range(n_trees):
        tree = Tree()
        tree.grow(sample, leaf_rows, np.random.default_rng(seed + i))
        tree.freeze()
        trees.append(tree)
    return trees


def margin_for(trees: list[Tree], q: np.ndarray, v: np.ndarray, recall: float) -> float:
    """The threshold at which the share recall of the pairs (row of q, its neighbour in v) meet in some leaf."""
    if not len(v) or not trees:
        return 0.0
    needed = np.min([t.crossed(q, v) for t in trees], axis=0)
    return max(0.0, float(np.quantile(needed, recall, method="higher")) * (1 + 1e-6))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v of the vectors that take part; single precision stays so, all else becomes double."""
    kept = vectors.schema[vector_col].dataType.simpleString()
    v = F.col(vector_col).cast(kept if kept == "array<float>" else "array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (width[0][0] if width else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def nearest(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, id, distance) of the k rows nearest to each query, not farther than its bound: preselected by a
    product, then exact."""
    rough = (rows**2).sum(1)[None] - 2 * queries @ rows.T
    n = min(len(rows), k + SLACK)
    pick = np.argpartition(rough, n - 1, axis=1)[:, :n] if n < len(rows) else np.broadcast_to(np.arange(n), rough.shape)
    d = np.sqrt(((rows[pick] - queries[:, None]) ** 2).sum(2))
    order = np.lexsort((ids[pick], d))[:, :k]
    i, near, d = np.repeat(np.arange(len(queries)), order.shape[1]), ids[np.take_along_axis(pick, order, 1)].ravel(), np.take_along_axis(d, order, 1).ravel()
    if bounds is None:
        return i, near, d
    within = d <= bounds[i]
    return i[within], near[within], d[within]


def true_neighbours(distinct: DataFrame, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of q, vectors of their k nearest distinct vectors but themselves), by comparing all rows with q."""
    kind = distinct.schema["v"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                i, at, d = nearest(_matrix(batch.column("v")), np.arange(len(batch)), q, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(d), batch.column("rep").take(pa.array(at)), batch.column("v").take(pa.array(at))], ["i", "d", "rep", "v"])

    best = Window.partitionBy("i").orderBy("d", "rep")
    found = distinct.select("rep", "v").mapInArrow(compare, f"i int, d double, rep long, v {kind}")
    found = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth").between(2, k + 1)).select("i", "v").toArrow()
    return q[found.column("i").to_numpy()], _matrix(found.column("v")) if len(found) else np.zeros((0, q.shape[1]))


@dataclass
class Forest:
    """The trees, how far a search goes, and a part of the sample that bounds distances."""

    trees: list[Tree]
    threshold: float
    sample: np.ndarray
    probes: float

    @property
    def leaves(self) -> int:
        return max([t.leaves for t in self.trees], default=1)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """(row, tree) -> leaf."""
        return np.array([t.leaf(x) for t in self.trees]).T.astype(np.int32)

    def bound(self, q: np.ndarray, k: int) -> np.ndarray:
        """For each query a distance within which its k nearest are."""
        if len(self.sample) < k:
            return np.full(len(q), math.inf)
        d = np.maximum(0, (q**2).sum(1)[:, None] + (self.sample**2).sum(1)[None] - 2 * q @ self.sample.T)
        return np.sqrt(np.partition(d, k - 1, axis=1)[:, k - 1]) * (1 + 1e-6) + 1e-6


def grow_forest(distinct: DataFrame, points: DataFrame, n: int, k: int, n_trees: int, sample_rows: int, leaf_rows: int, calibration: int, recall: float) -> Forest:
    """A forest for the n distinct vectors, with the threshold at which it finds the share recall of the neighbours."""
    drawn = F.pmod(F.xxhash64("v"), F.lit(_SAMPLE_SPACE)) < math.ceil(_SAMPLE_SPACE * min(1.0, sample_rows / max(n, 1)))
    sample = distinct.where(drawn).select("rep", "v").toArrow().sort_by("rep")
    if not len(sample):
        return Forest([], 0.0, np.zeros((0, 1)), 1)
    x = _matrix(sample.column("v"))
    trees = fit(x, n_trees, max(LEAST_LEAF, min(leaf_rows, leaf_rows * len(x) // n)), 7)
    asked = points.orderBy(F.xxhash64("v"), "point").limit(calibration).select("v").toArrow()
    if not len(asked):
        return Forest(trees, 0.0, x[:BOUND_ROWS], 1)
    q = _matrix(asked.column("v"))
    threshold = margin_for(trees, *true_neighbours(distinct, q, k), recall)
    return Forest(trees, threshold, x[np.random.default_rng(7).permutation(len(x))[:BOUND_ROWS]], float(np.mean([len(search(trees, p, threshold)) for p in q])))


def knn(
    vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, n_trees: int = 12,
    sample_rows: int = 65_536, leaf_rows: int = 64, calibration: int = 64, recall: float = 0.94,
) -> DataFrame:
    """query_id, rank, id_col, score of the k rows nearest to each row of queries, a query's own id left out.

    recall is the share of the true neighbours at which the search is set, on `calibration` of the queries.
    """
    rows = usable(vectors, id_col, vector_col)
    own = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= k + 1)
    distinct = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("rep", F.col("ids")[0])
    # Rows of one id with several vectors share a rep: they are told apart by a number of their own.
    distinct = materialize(distinct.withColumn("rep", F.monotonically_increasing_id()), "ann-vectors")
    asked = usable(queries, id_col, vector_col).withColumnRenamed("id", "query_id")
    points = materialize(asked.groupBy("v").agg(F.min("query_id").alias("least")).withColumn("point", F.monotonically_increasing_id()), "ann-queries")
    n, n_points = distinct.count(), points.count()
    forest = grow_forest(distinct, points, n, k, n_trees, sample_rows, leaf_rows, calibration, recall)
    row_blocks = max(1, math.ceil(n / forest.leaves / ROWS_PER_BLOCK))
    query_blocks = max(1, math.ceil(n_points * forest.probes / max(1, len(forest.trees)) / forest.leaves / QUERIES_PER_BLOCK))

    @F.arrow_udf("array<int>")
    def leaf_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for v in batches:
            found = forest.leaf_of(_matrix(v)) if len(v) else np.zeros((0, len(forest.trees)), np.int32)
            yield pa.ListArray.from_arrays(np.arange(0, found.size + 1, max(1, len(forest.trees)), dtype=np.int32), pa.array(found.ravel()))

    @F.arrow_udf("struct<cells:array<bigint>,bound:double>")
    def sought_in(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for v in batches:
            q = _matrix(v) if len(v) else np.zeros((0, 1))
            cells = pa.array([search(forest.trees, x, forest.threshold) for x in q], pa.list_(pa.int64()))
            yield pa.StructArray.from_arrays([cells, pa.array(forest.bound(q, k + 1) if len(q) else np.zeros(0))], ["cells", "bound"])

    blocks = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    stored = distinct.select("rep", "v", F.posexplode(leaf_of("v")).alias("tree", "leaf"))
    stored = stored.withColumn("cell", F.shiftleft(F.col("tree").cast("long"), 32).bitwiseOR(F.col("leaf").cast("long"))).drop("tree", "leaf")
    stored = stored.withColumn("row_block", F.pmod(F.xxhash64("rep"), F.lit(row_blocks)).cast("int")).withColumn("query_block", blocks(query_blocks))
    sought = points.select("point", F.col("v").alias("q"), sought_in("v").alias("at")).select("point", "q", "at.bound", F.explode("at.cells").alias("cell"))
    sought = sought.withColumn("query_block", F.pmod(F.xxhash64("point", "cell"), F.lit(query_blocks)).cast("int")).withColumn("row_block", blocks(row_blocks))
    key = ["cell", "row_block", "query_block"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"point": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        i, ids, d = nearest(_matrix(left.column("v")), left.column("rep").to_numpy(), _matrix(right.column("q")), k + 1, right.column("bound").to_numpy())
        return pa.table({"point": right.column("point").to_numpy()[i], "rep": ids, "score": d})

    near = stored.groupBy(*key).cogroup(sought.groupBy(*key)).applyInArrow(meet, "point long, rep long, score double")
    # More than k + 1 vectors can be as near as the last one, and the smaller ids must win: ties are kept until ids are there.
    near = near.groupBy("point", "rep").agg(F.min("score").alias("score"))
    near = near.withColumn("nth", F.rank().over(Window.partitionBy("point").orderBy("score"))).where(F.col("nth") <= k + 1)
    near = near.join(distinct.select("rep", "ids"), "rep").select("point", "score", F.explode("ids").alias("id"))
    near = near.join(asked.join(points, "v").select("point", "query_id"), "point").where("id <> query_id")
    last = Window.partitionBy("query_id").orderBy("score", "id")
    out = near.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("id").alias(id_col), "score")
