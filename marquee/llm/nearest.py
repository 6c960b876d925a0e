"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

Fit: on a bounded sample of distinct vectors (SAMPLE rows, the smallest hashes) each tree splits at
the median of a projection onto the difference of two random members, until a leaf holds at most
LEAF sample rows. All rows are then indexed in every tree.

Search: one priority queue over the nodes of all trees, ordered by how far on the wrong side of its
splits a branch lies. Leaves are taken until the next one lies farther than `reach`. The reach is
calibrated on the sample: for PROBES sample rows the true neighbours are known, and it is the
distance within which `recall_target` of them lie in some tree. It holds for larger tables too,
where neighbours are nearer than in the sample. Candidates of the leaves taken are scored exactly, leaf by leaf
as matrices in blocks of leaves, and only the best of a block leave it.

Equal vectors are searched once: a group of them is one indexed row with its k + 1 smallest ids, so
copies cost nothing and a very common vector is no hot key.

Defined results: vectors that are null, zero, hold null or non-finite components or differ in
length from the longest common length take no part; rows with a null id take no part; ties go to the smaller id;
repeated rows of one id count once; further columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import materialise
from .registry import ship

SAMPLE = 20_000
LEAF = 16
TREES = 12
PROBES = 400
RECALL_TARGET = 0.98
BLOCK_LEAVES = 16
#: Vectors of a block that are scored in one task, about; a larger block is salted.
GROUP_ROWS = 1 << 14


class Forest:
    """Flat arrays of all trees: normals and cuts of the inner nodes, children (a leaf as -1 - number), roots."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int = 17):
        self.normals, self.cuts, self.low, self.high, self.roots = [], [], [], [], []
        self.leaf_rows: list[int] = []
        self.sample_leaf = np.zeros((trees, len(sample)), "int64")
        rng = np.random.default_rng(seed)
        for t in range(trees):
            self.roots.append(self._grow(sample, np.arange(len(sample)), leaf, rng, t))
        dims = sample.shape[1]
        self.normals = np.array(self.normals, "f4").reshape(-1, dims)
        self.cuts = np.array(self.cuts, "f8")
        self.low, self.high = np.array(self.low, "int64"), np.array(self.high, "int64")
        self.reach = np.inf

    def _close(self, rows, tree):
        self.leaf_rows.append(len(rows))
        self.sample_leaf[tree, rows] = len(self.leaf_rows) - 1
        return -len(self.leaf_rows)

    def _grow(self, x, rows, leaf, rng, tree):
        if len(rows) <= leaf:
            return self._close(rows, tree)
        a, b = rng.choice(rows, 2, replace=False)
        normal = (x[a] - x[b]).astype("f4").astype("f8")
        size = np.sqrt(normal @ normal)
        if not size > 0:
            return self._close(rows, tree)
        normal = (normal / size).astype("f4")
        p = x[rows] @ normal.astype("f8")
        half = len(p) // 2
        middle = np.partition(p, [half - 1, half])[[half - 1, half]]
        # Between two members, so that rounding cannot move one across.
        cut = float(middle.mean())
        lower = p < cut
        if lower.all() or not lower.any():
            return self._close(rows, tree)
        node = len(self.normals)
        for arr, v in ((self.normals, normal), (self.cuts, cut), (self.low, 0), (self.high, 0)):
            arr.append(v)
        self.low[node] = self._grow(x, rows[lower], leaf, rng, tree)
        self.high[node] = self._grow(x, rows[~lower], leaf, rng, tree)
        return node

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row of unit vectors x in each tree: trees x rows."""
        out = np.empty((len(self.roots), len(x)), "int64")
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root, "int64")
            live = np.flatnonzero(at >= 0)
            while len(live):
                nodes = at[live]
                side = np.einsum("ij,ij->i", x[live], self.normals[nodes].astype("f8")) >= self.cuts[nodes]
                at[live] = np.where(side, self.high[nodes], self.low[nodes])
                live = live[at[live] >= 0]
            out[t] = -1 - at
        return out

    def margins(self, q: np.ndarray) -> np.ndarray:
        return self.normals.astype("f8") @ q - self.cuts

    def search(self, q: np.ndarray, at_least: int) -> list[int]:
        """Leaves for a unit vector: the queue is shared by all trees, nearest branch first."""
        side = self.margins(q).tolist()
        low, high, rows = self.low_list, self.high_list, self.leaf_rows
        queue = [(0.0, r) for r in self.roots]
        heapq.heapify(queue)
        taken, n = [], 0
        while queue:
            far, node = heapq.heappop(queue)
            if far > self.reach and n >= at_least:
                break
            if node < 0:
                taken.append(-1 - node)
                n += rows[-1 - node]
            else:
                m = side[node]
                heapq.heappush(queue, (max(far, -m), high[node]))
                heapq.heappush(queue, (max(far, m), low[node]))
        return taken

    @property
    def low_list(self):
        if not hasattr(self, "_lists"):
            self._lists = self.low.tolist(), self.high.tolist()
        return self._lists[0]

    @property
    def high_list(self):
        self.low_list  # noqa: B018
        return self._lists[1]

    def calibrate(self, sample: np.ndarray, k: int, probes: int, target: float) -> None:
        """Sets the reach: how far the nearest leaf of a true neighbour lies, at the target quantile."""
        if len(sample) <= k + 1 or not len(self.normals):
            return
        rows = np.linspace(0, len(sample) - 1, min(probes, len(sample))).astype("int64")
        found = []
        for r in rows:
            sims = sample @ sample[r]
            sims[r] = -np.inf
            near = np.argpartition(-sims, k)[:k]
            far = self._distance_to_leaves(sample[r])
            found.append(far[self.sample_leaf[:, near]].min(axis=0))
        self.reach = float(np.quantile(np.concatenate(found), target))

    def _distance_to_leaves(self, q):
        """How far on the wrong side each leaf lies for q, from the roots down."""
        side, out = self.margins(q).tolist(), np.zeros(len(self.leaf_rows))
        stack = [(0.0, r) for r in self.roots]
        while stack:
            far, node = stack.pop()
            if node < 0:
                out[-1 - node] = far
            else:
                m = side[node]
                stack.append((max(far, -m), self.high_list[node]))
                stack.append((max(far, m), self.low_list[node]))
        return out


def unit_rows(buffers, kind: str, dims: int):
    """(vectors, unit vectors) in double precision from packed components."""
    x = np.frombuffer(b"".join(buffers), kind).reshape(-1, dims).astype("f8")
    return x, x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def distinct_vectors(table: DataFrame, is_query, k: int, id_col: str, vec_col: str, kind: str):
    """(vectors, asked_ids): one row per distinct valid vector: rep (smallest id), ids (k + 1 smallest), asked, vec
    (packed); and (query_id, rep) of every row asked about."""
    valid = (
        F.col("id").isNotNull()
        & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0)
    )

    def pack(batches):
        for b in batches:
            vecs = [np.asarray(v, kind).tobytes() for v in b.column(1).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vecs, pa.binary()), b.column(2)], ["id", "vec", "asked"])

    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).withColumn("asked", is_query(F.col("id"))).filter(valid)
    # -0.0 and 0.0 are the same component
    rows = rows.withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0).cast("float" if kind == "<f4" else "double")).otherwise(x)))
    packed = rows.mapInArrow(pack, "id long, vec binary, asked boolean")
    one = packed.groupBy("vec", "id").agg(F.max("asked").alias("asked"))
    asked = one.groupBy("vec").agg(F.max("asked").alias("asked"))
    first = one.withColumn("r", F.row_number().over(W.partitionBy("vec").orderBy("id"))).filter(F.col("r") <= k + 1)
    ids = first.groupBy("vec").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids"))
    vectors = materialise(ids.join(asked, "vec"), "vectors")
    asked_ids = one.filter("asked").select("vec", F.col("id").alias("query_id")).join(vectors.select("vec", "rep"), "vec").drop("vec")
    return vectors, asked_ids


def _place(model, kind, dims):
    """Distinct vectors -> a row per tree: block of leaves, leaf, rep, vec."""

    def run(batches):
        forest = model()
        for b in batches:
            if not b.num_rows:
                continue
            x, u = unit_rows(b.column("vec").to_pylist(), kind, dims)
            leaf = forest.leaves(u)
            trees = leaf.shape[0]
            ix = pa.array(np.tile(np.arange(b.num_rows), trees))
            leaf = leaf.reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf // BLOCK_LEAVES), pa.array(leaf), b.column("rep").take(ix), b.column("vec").take(ix)],
                ["block", "leaf", "rep", "vec"],
            )

    return run


def _probe(model, kind, dims, k):
    """Query vectors -> a row per block with the leaves to look at."""

    def run(batches):
        forest = model()
        for b in batches:
            if not b.num_rows:
                continue
            _, u = unit_rows(b.column("vec").to_pylist(), kind, dims)
            blocks, leaves, at = [], [], []
            for i, q in enumerate(u):
                taken = np.sort(np.array(forest.search(q, 4 * (k + 1)), "int64"))
                block, start = np.unique(taken // BLOCK_LEAVES, return_index=True)
                blocks += block.tolist()
                leaves += [x.tolist() for x in np.split(taken, start[1:])]
                at += [i] * len(block)
            ix = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), pa.array(leaves, pa.list_(pa.int64())), b.column("rep").take(ix), b.column("vec").take(ix)],
                ["block", "leaves", "rep", "vec"],
            )

    return run


def _score(kind, dims, keep):
    """One block of leaves and the queries that look into it -> the best candidates per query."""
    names = ["query", "rep", "score"]

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({n: pd.Series(dtype="f8" if n == "score" else "int64") for n in names})
        rows = rows.sort_values(["leaf", "rep"], kind="stable")
        x, _ = unit_rows(rows["vec"], kind, dims)
        y, _ = unit_rows(asked["vec"], kind, dims)
        nx, ny = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", y, y))
        rep, query = rows["rep"].to_numpy(), asked["rep"].to_numpy()
        leaf, start = np.unique(rows["leaf"].to_numpy(), return_index=True)
        ends = dict(zip(leaf.tolist(), zip(start.tolist(), [*start[1:].tolist(), len(rows)])))
        out = ([], [], [])
        lists = [list(v) for v in asked["leaves"]]
        # Queries with the same leaves share a product; a block has few leaves, so a query is scored against its rows of it.
        for i, wanted in enumerate(lists):
            cuts = [ends[v] for v in wanted if v in ends]
            if not cuts:
                continue
            at = np.concatenate([np.arange(a, b) for a, b in cuts])
            # A block can hold leaves of two trees, and so a row twice.
            at = at[np.unique(rep[at], return_index=True)[1]]
            s = (x[at] @ y[i]) / (nx[at] * ny[i])
            best = np.lexsort((rep[at], -s))[:keep]
            out[0].append(np.full(len(best), query[i]))
            out[1].append(rep[at][best])
            out[2].append(s[best])
        if not out[0]:
            return pd.DataFrame({n: pd.Series(dtype="f8" if n == "score" else "int64") for n in names})
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, out)})

    return run


def nearest(
    table: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
    trees: int = TREES, leaf: int = LEAF, sample_rows: int = SAMPLE, recall_target: float = RECALL_TARGET, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every row that is_query(id column) selects."""
    spark = table.sparkSession
    kind = "<f4" if dict(table.dtypes)[vec_col] == "array<float>" else "<f8"
    vectors, asked_ids = distinct_vectors(table, is_query, k, id_col, vec_col, kind)
    width = F.octet_length("vec")
    usual = vectors.groupBy(width.alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = usual["w"] // int(kind[-1])
    vectors = vectors.filter(width == usual["w"])
    h = F.shiftrightunsigned(F.xxhash64("rep"), 1)
    share = min(1.0, 1.25 * sample_rows / usual["count"])
    chosen = vectors.filter(h <= min(int(share * 2**62) * 2, 2**63 - 1)).select("vec", h.alias("h")).toArrow().sort_by("h")["vec"].to_pylist()[:sample_rows]
    _, sample = unit_rows(chosen, kind, dims)
    forest = Forest(sample, trees, leaf)
    forest.calibrate(sample, k, PROBES, recall_target)
    forest.sample_leaf = None
    model = ship(spark, forest)

    placed = vectors.select("rep", "vec").mapInArrow(_place(model, kind, dims), "block long, leaf long, rep long, vec binary")
    asked = vectors.filter("asked").select("rep", "vec")
    asked = asked.repartition(spark.sparkContext.defaultParallelism, "rep")
    probes = asked.mapInArrow(_probe(model, kind, dims, k), "block long, leaves array<long>, rep long, vec binary")
    # Leaves grow with the table: a block is cut by a hash of its vectors, and its queries meet every part.
    blocks = -(-len(forest.leaf_rows) // BLOCK_LEAVES)
    salts = max(1, -(-usual["count"] * trees // (blocks * group_rows)))
    parts = placed.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(salts)).cast("int")).groupBy("block", "salt")
    asking = probes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).groupBy("block", "salt")
    found = parts.cogroup(asking).applyInPandas(_score(kind, dims, k + 1), "query long, rep long, score double")
    once = found.groupBy("query", "rep").agg(F.max("score").alias("score"))
    best = once.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "rep"))).filter(F.col("r") <= k + 1)

    near = best.join(vectors.select("rep", "ids"), "rep").select("query", F.explode("ids").alias("vec_id"), "score")
    near = near.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("near"))
    # Copies of one vector share a search; each leaves itself out and takes the k first.
    shown = F.slice(F.filter("near", lambda c: c["vec_id"] != F.col("query_id")), 1, k)
    got = asked_ids.join(near, asked_ids["rep"] == near["query"]).select("query_id", F.posexplode(shown).alias("p", "c"))
    return got.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("c.vec_id").alias("vec_id"), (-F.col("c.s")).alias("score"))
