"""Boosted trees that grow leaf by leaf, for out-of-fold predictions.

Every fold's model is fitted on all of its training rows. Columns are binned once; a split is found from sums of gradients
by feature and bin (gradient_sums has them for the first split over all rows). The leaf with the best gain is split next,
until a tree has its leaves. Predictions are made for all rows where they are.

Up to max_rows training rows, a byte a column, are fitted by one task for each fold and size, side by side. More stay dealt
over the cluster as blocks of bins, and the models of all folds and sizes grow in step: a job adds the last trees to the blocks' scores and
sums the gradients of all rows, or of the leaves that may be split next, and the driver, which gets these sums only,
picks the splits. Gradients are whole multiples of GRAIN, so that sums don't hang on an order and both ways agree.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convolytics.operators.splits import purged_pairs
from convolytics.sources.sinks import materialize, scratch

BINS = 255
#: Sums of fewer than 2**23 such multiples up to 1 are exact.
GRAIN = 2.0**-30
#: Rows of a block; ranges of a column's values that are put in order by themselves; rounds after which scores are made
#: anew from the trees, so that no job carries a long chain of rounds.
BLOCK_ROWS, RANGES, ANEW = 1 << 16, 16, 25
#: Leaves of a tree of the two sizes that are compared.
TREE_LEAVES = {"trees_7": 7, "trees_15": 15}


def bin_edges(x: np.ndarray) -> np.ndarray:
    """Upper edges of at most BINS bins: between distinct values, or at evenly spaced quantiles if there are more."""
    values = np.unique(x)
    if len(values) <= BINS:
        return (values[:-1] + values[1:]) / 2
    return np.unique(np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], method="midpoint"))


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.int32)


def gradients(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both gradients of the log loss."""
    p = 1 / (1 + np.exp(-score))
    return np.rint((p - y) / GRAIN) * GRAIN, np.rint(p * (1 - p) / GRAIN) * GRAIN


def best_split(sums: np.ndarray, least: int, l2: float) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best split; gain 0 if none is allowed. sums: of rows and both gradients by feature and bin."""
    n, g, h = np.cumsum(sums, axis=2)
    gain = lambda g, h: g * g / (h + l2 + 1e-12)
    total = gain(g, h) + gain(g[:, -1:] - g, h[:, -1:] - h) - gain(g[:, -1:], h[:, -1:])
    total[(n < least) | (n[:, -1:] - n < least)] = 0.0
    at = int(np.argmax(total))
    return float(total.ravel()[at]), *divmod(at, sums.shape[2])


class Grower:
    """One tree over binned rows: (feature, bin, left, right, value) by node; a row goes left if its bin is not above."""

    def __init__(self, bins: np.ndarray, leaves: int, least: int, l2: float):
        self.columns = np.ascontiguousarray(bins.T, np.uint8)
        self.leaves, self.least, self.l2 = leaves, least, l2

    def sums(self, rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Counts and sums of both gradients by feature and bin."""
        out, weights = np.empty((3, len(self.columns), BINS + 1)), (None, g[rows], h[rows])
        for j, column in enumerate(self.columns):
            codes = column[rows]
            out[:, j] = [np.bincount(codes, w, BINS + 1) for w in weights]
        return out

    def best(self, sums: np.ndarray) -> tuple[float, int, int]:
        return best_split(sums, self.least, self.l2)

    def grow(self, g: np.ndarray, h: np.ndarray, step: float) -> tuple[list, np.ndarray]:
        """The tree's nodes and what it adds to each row."""
        value = lambda rows: -step * float(g[rows].sum() / (h[rows].sum() + self.l2 + 1e-12))
        rows = np.arange(len(g))
        nodes, held = [[-1, 0, 0, 0, value(rows)]], {0: (rows, self.sums(rows, g, h))}
        first = self.best(held[0][1])
        queue = [(-first[0], 0, *first[1:])]
        leaves = 1
        while queue and leaves < self.leaves:
            gain, node, feature, cut = heapq.heappop(queue)
            if gain > -1e-9:
                break
            rows, sums = held.pop(node)
            goes = self.columns[feature][rows] <= cut
            left, right = rows[goes], rows[~goes]
            small = self.sums(left if len(left) <= len(right) else right, g, h)
            both = (small, sums - small) if len(left) <= len(right) else (sums - small, small)
            nodes[node][:4] = feature, cut, len(nodes), len(nodes) + 1
            for own, s in ((left, both[0]), (right, both[1])):
                held[len(nodes)] = own, s
                gain, *at = self.best(s)
                heapq.heappush(queue, (-gain, len(nodes), *at))
                nodes.append([-1, 0, 0, 0, value(own)])
            leaves += 1
        added = np.zeros(len(g))
        for node, (rows, _) in held.items():
            added[rows] = nodes[node][4]
        return nodes, added


def log_odds(mean: float) -> float:
    mean = float(np.clip(mean, 1e-6, 1 - 1e-6))
    return float(np.log(mean / (1 - mean)))


def fit(x: np.ndarray, y: np.ndarray, leaves: int, rounds: int, step: float, least: int, l2: float) -> dict:
    """A model of log odds: edges, where it begins and its trees."""
    edges = [bin_edges(x[:, j]) for j in range(x.shape[1])]
    return {"edges": edges, "start": log_odds(y.mean()), "trees": fit_bins(binned(x, edges).T, y, leaves, rounds, step, least, l2)}


def fit_bins(columns: np.ndarray, y: np.ndarray, leaves: int, rounds: int, step: float, least: int, l2: float) -> list:
    """Trees for the log odds of y, on top of its mean. columns: bins by feature."""
    grower, trees, score = Grower(columns.T, leaves, least, l2), [], np.full(len(y), log_odds(y.mean()))
    for _ in range(rounds if 0 < y.mean() < 1 else 0):
        nodes, added = grower.grow(*gradients(score, y), step)
        trees.append(nodes)
        score += added
    return trees


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    bins, score = np.ascontiguousarray(binned(x, model["edges"]).T), np.full(len(x), model["start"])
    for nodes in model["trees"]:
        score += np.array([n[4] for n in nodes])[places(bins, nodes)]
    return 1 / (1 + np.exp(-score))


def places(columns: np.ndarray, nodes: Sequence[Sequence]) -> np.ndarray:
    """The leaf of each row. columns: bins by feature; a node comes before its children."""
    at = np.zeros(columns.shape[1], np.int32)
    for i, (feature, cut, left, right, *_) in enumerate(nodes):
        if feature >= 0:
            rows = np.flatnonzero(at == i)
            at[rows] = np.where(columns[feature][rows] <= cut, left, right)
    return at


def alone(df: DataFrame, column: str, values: int) -> DataFrame:
    """df dealt so that each of about so many, about equally frequent values of the column has a task of its own.

    By hash several of a few values meet in one task, and Spark joins small ones, however long their work takes. Ranges
    of a quarter of a value's rows end at each value, and keep their number.
    """
    return df.repartitionByRange(4 * values, column)


def value_edges(rows: DataFrame) -> dict[int, list[np.ndarray]]:
    """bin_edges of each eval_fold's training rows, by feature, exactly, without a column's values in one task. rows: x, trains.

    Values are counted by feature; each of RANGES ranges of a feature's values is put in order by itself, and what lies in
    the ranges before is added. Only the values next to a quantile's place, or the few there are, go on.
    """
    folds = sorted(r[0] for r in rows.select(F.explode("trains")).distinct().collect())  # k rows
    own = [F.sum(F.array_contains("trains", f).cast("long")).alias(f"n{f}") for f in folds]
    values = materialize(rows.select(F.posexplode("x").alias("feature", "value"), "trains").groupBy("feature", "value").agg(*own), "tree-values")
    cuts = values.groupBy("feature").agg(F.percentile_approx("value", [i / RANGES for i in range(1, RANGES)], 1000).alias("cuts"))
    ranged = values.join(F.broadcast(cuts), "feature").withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    sizes = ranged.groupBy("feature", "range").agg(F.array(*[F.sum(f"n{f}") for f in folds]).alias("n"), F.array(*[F.count_if(F.col(f"n{f}") > 0) for f in folds]).alias("d"))
    sizes = sizes.select("feature", "range", F.explode(F.arrays_zip(F.array(*map(F.lit, folds)).alias("f"), "n", "d")).alias("s")).select("feature", "range", "s.*")
    before, whole = Window.partitionBy("feature", "f").orderBy("range"), Window.partitionBy("feature", "f")
    sizes = sizes.withColumns({"before": F.sum("n").over(before) - F.col("n"), "rows": F.sum("n").over(whole), "values": F.sum("d").over(whole)})
    sizes = sizes.groupBy("feature", "range").agg(F.array_sort(F.collect_list(F.struct("f", "before", "rows", "values"))).alias("s"))
    here = Window.partitionBy("feature", "range").orderBy("value")
    ranked = ranged.join(F.broadcast(sizes), ["feature", "range"]).withColumns({f"p{f}": F.sum(f"n{f}").over(here) - F.col(f"n{f}") for f in folds})
    of_fold = [F.struct(F.lit(f).alias("eval_fold"), F.col(f"n{f}").alias("n"), (F.col("s")[i]["before"] + F.col(f"p{f}")).alias("place"), F.col("s")[i]["rows"].alias("rows"), F.col("s")[i]["values"].alias("values")) for i, f in enumerate(folds)]
    ranked = ranked.select("feature", "value", F.explode(F.array(*of_fold)).alias("f")).select("feature", "value", "f.*").where("n > 0")
    at = lambda place: place * BINS / (F.col("rows") - 1)
    near = F.floor(at(F.col("place") + F.col("n") + 0.5)) >= F.ceil(at(F.col("place") - 1.5))
    few = ranked.where((F.col("values") <= BINS) | near).select("eval_fold", "feature", "value", "place", "rows", "values")

    def edges(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("value")
        v, place, n = part.value.to_numpy(), part.place.to_numpy(), int(part.rows.iloc[0])
        if part["values"].iloc[0] <= BINS:
            found = (v[:-1] + v[1:]) / 2
        else:
            wanted = (n - 1) * np.linspace(0, 1, BINS + 1)[1:-1]
            low, high = (v[np.searchsorted(place, x, side="right") - 1] for x in (np.floor(wanted), np.ceil(wanted)))
            found = np.unique(np.where(low == high, low, high - (high - low) * 0.5))
        return pd.DataFrame({"eval_fold": [key[0]], "feature": [key[1]], "edges": [found]})

    out: dict[int, dict[int, np.ndarray]] = {f: {} for f in folds}
    for r in few.groupBy("eval_fold", "feature").applyInPandas(edges, "eval_fold int, feature int, edges array<double>").collect():  # BINS numbers each
        out[r.eval_fold][r.feature] = np.array(r.edges, np.float64)
    return {f: [by[j] for j in sorted(by)] for f, by in out.items()}


def bin_blocks(rows: DataFrame, edges: Mapping[int, Sequence[np.ndarray]], tasks: int) -> DataFrame:
    """eval_fold, block, n, bins (by feature), y: blocks of BLOCK_ROWS training rows of a fold at most. rows: y, x, trains."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {f: [] for f in edges}
        block = TaskContext.get().partitionId() << 32

        def full(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal block
            for f, parts in held.items():
                if parts and sum(len(y) for _, y in parts) >= least:
                    bins, y = (np.concatenate(x, axis=-1) for x in zip(*parts, strict=True))
                    parts.clear()
                    yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([block], pa.int64()), pa.array([len(y)], pa.int32()), pa.array([bins.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["eval_fold", "block", "n", "bins", "y"])
                    block += 1

        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK_ROWS // 4):
                batch = whole.slice(start, BLOCK_ROWS // 4)
                x, y = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), batch.column("y").to_numpy(zero_copy_only=False)
                trains = batch.column("trains")
                row = np.repeat(np.arange(batch.num_rows), trains.value_lengths().to_numpy(zero_copy_only=False))
                of = trains.flatten().to_numpy(zero_copy_only=False)
                for f in np.unique(of).tolist():
                    mine = row[of == f]
                    held[f].append((binned(x[mine], edges[f]).T.astype(np.uint8), y[mine]))
                yield from full(3 * BLOCK_ROWS // 4)
        yield from full(1)

    return rows.repartition(tasks).mapInArrow(blocks, "eval_fold int, block long, n int, bins binary, y binary")


def node_sums(bins: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, wanted: Sequence[int], widths: Sequence[int]) -> np.ndarray:
    """Counts and sums of both gradients of the nodes wanted, by node and by bin, one feature's bins after another."""
    nth = np.full(max(int(at.max()), *wanted) + 1, -1)
    nth[wanted] = np.arange(len(wanted))
    nth = nth[at]
    rows = np.flatnonzero(nth >= 0)
    nth, weights, offset = nth[rows], (None, g[rows], h[rows]), 0
    out = np.empty((3, len(wanted), sum(widths)))
    for column, width in zip(bins, widths, strict=True):
        codes = nth * width + column[rows]
        for i, w in enumerate(weights):
            out[i, :, offset : offset + width] = np.bincount(codes, w, len(wanted) * width).reshape(-1, width)
        offset += width
    return out


class Growth:
    """A tree that grows on the driver from sums by node. ask() splits the leaves that may be split next and gives the
    nodes whose sums are needed (of two children the smaller; the other has the rest); tell() takes these sums."""

    def __init__(self, leaves: int, least: int, l2: float, step: float):
        self.leaves, self.least, self.l2, self.step = leaves, least, l2, step
        self.nodes, self.sums, self.best, self.asked = [[-1, 0, 0, 0, 0.0]], {}, {}, {0: None}

    def tell(self, sums: Mapping[int, np.ndarray]) -> None:
        for node, parent in self.asked.items():
            if parent is not None:
                twin = sum(self.nodes[parent][2:4]) - node
                self._know(twin, self.sums.pop(parent) - sums[node])
            self._know(node, sums[node])
        self.asked = {}

    def _know(self, node: int, sums: np.ndarray) -> None:
        self.sums[node], self.best[node] = sums, best_split(sums, self.least, self.l2)
        _, g, h = sums[:, 0].sum(axis=1)
        self.nodes[node][4] = -self.step * float(g / (h + self.l2 + 1e-12))

    def _grown(self) -> tuple[list, list[int]]:
        """The tree, best leaf first, as far as it is known; the leaves that may be split next, none when it is done."""
        tree, own = [[-1, 0, 0, 0, self.nodes[0][4]]], [0]
        queue, leaves = [(-self.best[0][0], 0)], 1
        while queue and leaves < self.leaves:
            gain, i = queue[0]
            if gain > -1e-9:
                break
            if self.nodes[own[i]][0] < 0:
                open_ = sorted((-gain[0], node) for node, gain in self.best.items() if self.nodes[node][0] < 0 and gain[0] >= 1e-9)
                return tree, sorted({own[i], *(node for _, node in open_[: self.leaves - leaves])})
            heapq.heappop(queue)
            feature, cut, left, right, _ = self.nodes[own[i]]
            tree[i][:4] = feature, cut, len(tree), len(tree) + 1
            for child in (left, right):
                heapq.heappush(queue, (-self.best[child][0], len(tree)))
                tree.append([-1, 0, 0, 0, self.nodes[child][4]])
                own.append(child)
            leaves += 1
        return tree, []

    def ask(self) -> list[int]:
        for node in () if self.asked else self._grown()[1]:
            _, feature, cut = self.best[node]
            n = self.sums[node][0, feature]
            left = len(self.nodes)
            self.nodes[node][:4] = feature, cut, left, left + 1
            self.nodes += [[-1, 0, 0, 0, 0.0], [-1, 0, 0, 0, 0.0]]
            self.asked[left if 2 * n[: cut + 1].sum() <= n.sum() else left + 1] = node
        return list(self.asked)

    def tree(self) -> list:
        return self._grown()[0]


def _advanced(blocks: RDD, trees: Mapping[int, Mapping[str, Sequence[list]]]) -> RDD:
    """Blocks (eval_fold, bins, y, scores by name) with what more trees add to the scores."""

    def add(block: tuple) -> tuple:
        fold, bins, y, scores = block
        new = {name: score.copy() for name, score in scores.items()}
        for name, more in trees.get(fold, {}).items():
            for nodes in more:
                new[name] += np.array([n[4] for n in nodes])[places(bins, nodes)]
        return fold, bins, y, new

    return blocks.map(add, preservesPartitioning=True)


def _summed(blocks: RDD, asked: Mapping[int, Mapping[str, tuple[list, list[int]]]], widths: Mapping[int, list[int]]) -> dict[tuple[int, str], np.ndarray]:
    """node_sums over all blocks of each model that asks (nodes, wanted). Added up on the cluster, by model."""

    def sums(part: Iterator[tuple]) -> Iterator[tuple]:
        total: dict[tuple[int, str], np.ndarray] = {}
        for fold, bins, y, scores in part:
            for name, (nodes, wanted) in asked.get(fold, {}).items():
                own = node_sums(bins, *gradients(scores[name], y), places(bins, nodes), wanted, widths[fold])
                total[fold, name] = total[fold, name] + own if (fold, name) in total else own
        yield from total.items()

    return dict(blocks.mapPartitions(sums).reduceByKey(np.add, max(2, blocks.getNumPartitions() // 16)).collect())


def fit_in_step(
    stored: DataFrame, edges: Mapping[int, Sequence[np.ndarray]], facts: Mapping[int, tuple[int, float]], sizes: Mapping[str, int], rounds: int, step: float, least: int, l2: float
) -> dict[tuple[int, str], list]:
    """Trees by eval_fold and size, each the same as fit_bins() gives of all its rows. stored: bin_blocks; facts: number of
    training rows and their mean target, by eval_fold."""
    widths = {f: [len(e) + 1 for e in by] for f, by in edges.items()}
    start = {f: log_odds(mean) for f, (_, mean) in facts.items()}
    first = stored.rdd.map(lambda r: (r.eval_fold, np.frombuffer(r.bins, np.uint8).reshape(-1, r.n), np.frombuffer(r.y), {name: np.full(r.n, start[r.eval_fold]) for name in sizes}))
    trees: dict[int, dict[str, list]] = {f: {name: [] for name in sizes} for f in edges}
    live, blocks = [f for f in edges if 0 < facts[f][1] < 1], None
    for i in range(rounds if live else 0):
        last = blocks
        more = trees if i % ANEW == 0 else {f: {name: by[name][-1:] for name in sizes} for f, by in trees.items()}
        blocks = _advanced(first if i % ANEW == 0 else last, more).persist(StorageLevel.MEMORY_AND_DISK)
        grown = {(f, name): Growth(leaves, least, l2, step) for f in live for name, leaves in sizes.items()}
        while wanted := {k: nodes for k, tree in grown.items() if (nodes := tree.ask())}:
            sums = _summed(blocks, {f: {name: (grown[f, name].nodes, nodes) for (g, name), nodes in wanted.items() if g == f} for f in {f for f, _ in wanted}}, widths)
            for (f, name), nodes in wanted.items():
                apart = np.zeros((len(nodes), 3, len(widths[f]), BINS + 1))
                for j, part in enumerate(np.split(sums[f, name], np.cumsum(widths[f])[:-1], axis=2)):
                    apart[:, :, j, : widths[f][j]] = part.transpose(1, 0, 2)
                grown[f, name].tell(dict(zip(nodes, apart, strict=True)))
        if last is not None:
            last.unpersist()
        for (f, name), tree in grown.items():
            trees[f][name].append(tree.tree())
    if blocks is not None:
        blocks.unpersist()
    return {(f, name): by[name] for f, by in trees.items() for name in sizes}


def trees_out_of_fold(
    df: DataFrame, columns: Sequence[str], sizes: Mapping[str, int] = TREE_LEAVES, rounds: int = 250, step: float = 0.03, least: int = 100, l2: float = 1.0,
    folds: int = 5, key: str = "response_id", purge: str = "session_id", target: str = "target", max_rows: int = 1 << 20,
) -> DataFrame:
    """key, fold, target, p, model for each size (name: leaves). The rows are written once to the shared folder; nulls
    count as 0. max_rows: if a fold has more training rows, no task has a fold's rows: all models are fitted in step."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "trees")
    seen = df.groupBy(purge).agg(F.collect_set(F.col("fold").cast("int")).alias("_held"))
    trains = lambda f: (f != F.col("fold")) & ~F.coalesce(F.array_contains("_held", f), F.lit(False))
    filled = df.join(seen, purge, "left").select(key, "fold", target, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("x"), F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), trains).alias("trains"))
    filled.write.parquet(path)
    rows = spark.read.schema(filled.schema).parquet(path)
    pairs = rows.select(F.explode("trains").alias("eval_fold"), F.col(target).cast("double").alias("y"), "x")
    facts = {r.eval_fold: (r.n, r.mean) for r in pairs.groupBy("eval_fold").agg(F.count("*").alias("n"), F.avg("y").alias("mean")).collect()}  # a row a fold
    kinds = list(sizes.items())

    edges = value_edges(rows)
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(max((n for n, _ in facts.values()), default=0) / BLOCK_ROWS))
    blocks = materialize(bin_blocks(rows.select(F.col(target).cast("double").alias("y"), "x", "trains"), edges, tasks), "tree-blocks")

    def one(key: tuple, part: pa.Table) -> pa.Table:
        fold, nth = divmod(int(key[0].as_py()), len(kinds))
        part = part.sort_by("block")
        bins = np.concatenate([np.frombuffer(b.as_py(), np.uint8).reshape(len(edges[fold]), -1) for b in part.column("bins")], axis=1)
        y = np.concatenate([np.frombuffer(b.as_py()) for b in part.column("y")])
        trees = fit_bins(bins, y, kinds[nth][1], rounds, step, least, l2)
        return pa.table({"eval_fold": pa.array([fold], pa.int32()), "model": [kinds[nth][0]], "trees": [pickle.dumps(trees)]})

    if max((n for n, _ in facts.values()), default=0) <= max_rows:
        nth = F.explode(F.sequence(F.lit(0), F.lit(len(kinds) - 1))).alias("nth")
        each = blocks.select("eval_fold", "block", "bins", "y", nth).select((F.col("eval_fold") * len(kinds) + F.col("nth")).alias("fit"), "block", "bins", "y")
        fitted = alone(each, "fit", folds * len(kinds)).groupBy("fit").applyInArrow(one, "eval_fold int, model string, trees binary")
        trees = {(r.eval_fold, r.model): pickle.loads(bytes(r.trees)) for r in fitted.collect()}  # some 100 kB a tree size and fold
    else:
        trees = fit_in_step(blocks, edges, facts, sizes, rounds, step, least, l2)
    found = {(f, name): pickle.dumps({"edges": edges[f], "start": log_odds(facts[f][1]), "trees": own}) for (f, name), own in trees.items()}
    models = spark.sparkContext.broadcast(found)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {k: pickle.loads(v) for k, v in models.value.items()}
        for batch in batches:
            x, fold = np.stack(batch.column("x").to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, 1)), batch.column("fold").to_numpy()
            for name in sizes:
                p = np.full(batch.num_rows, 0.5)
                for f in np.unique(fold).tolist():
                    if (f, name) in known:
                        p[fold == f] = predict(known[f, name], x[fold == f])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, "fold", target)), pa.array(p), pa.array([name] * batch.num_rows)], names=[key, "fold", target, "p", "model"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(key, "fold", target, "x").mapInArrow(score, f"{key} {types[key]}, fold {types['fold']}, {target} {types[target]}, p double, model string")


def gradient_sums(df: DataFrame, edges: Mapping[str, Sequence[float]], folds: int = 5, purge: str = "session_id", target: str = "target") -> DataFrame:
    """eval_fold, feature, bin, n, g, h: counts and sums of both gradients of the log loss at the mean target, by bin of
    each feature (name: upper edges), over all training rows of each fold: what a first split is chosen by."""
    train = purged_pairs(df, purge, folds)
    mean = train.groupBy("eval_fold").agg(F.avg(target).alias("_p"))  # a row a fold

    def place(column: str) -> Column:
        return sum(((F.coalesce(F.col(column).cast("double"), F.lit(0.0)) > e).cast("int") for e in edges[column]), F.lit(0))

    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), place(c).alias("bin")) for c in edges]))
    sums = train.select("eval_fold", target, each.alias("f")).groupBy("eval_fold", "f.feature", "f.bin").agg(F.count("*").alias("n"), F.sum(target).alias("_y"))
    p, n = F.col("_p"), F.col("n")
    return sums.join(F.broadcast(mean), "eval_fold").select("eval_fold", "feature", "bin", "n", (n * p - F.col("_y")).alias("g"), (n * p * (1 - p)).alias("h"))
