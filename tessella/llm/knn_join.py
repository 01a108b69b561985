"""Exact top-k search by a Voronoi kNN join on integer inner products.

Vectors are turned into integers, ``floor(unit * x)``. A few pivots (k-means on a bounded sample) split
the space; data and queries are grouped by their nearest pivot. Per-cell summaries (rows, radius) give
each query group a score that its k-th best candidate reaches for sure, and tell which data cells can hold
anything that reaches it. Data is laid out in blocks by cell. A query goes to the blocks of cells that may
matter to its group and to no others; a data vector goes to a group only if its own upper bound (product
with the group's pivot plus the group's radius times its norm) reaches the group's score. Groups are solved
locally, block by block, and the blocks' best are merged by rank.

Bounds only prune what cannot be in a result. What groups would copy is known from the summaries
beforehand: where they would copy more than a single group of all queries, as on vectors without clusters,
there is a single group. The join then does all pairs of queries and data in blocks, as an exact search has to.

Equal vectors are one data point with its least ids, and equal query vectors are solved once, so a vector
that a third of the rows share costs no more than others. For each query vector the ``2 k`` best are kept,
with no id more than ``k`` times, so that ``k`` are left whichever id is the query's own.

Defined results: vectors that are null, hold null or non-finite components, or have no id take no part;
shorter vectors, also empty ones, count as zero beyond their end; integers and scores beyond a long are
cut to its range; every row is a candidate, repeated ones too; rows with the query's own id are never its
candidates; repeated query rows give one result, an id with several vectors one for each; ties go to the smaller id; empty tables give no rows;
other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.runtime import materialize


@dataclass(frozen=True)
class KnnConfig:
    k: int = 10
    unit: int = 1024
    #: queries to a pivot, and most pivots
    queries_per_pivot: int = 256
    min_pivots: int = 4
    max_pivots: int = 256
    pivot_sample: int = 4096
    data_block: int = 8192
    query_block: int = 2048
    seed: int = 7


_MOST = (1 << 63) - 1
#: Products held at once.
_SLAB = 1 << 20


def _integers(unit: int):
    def run(batches):
        for batch in batches:
            ids, rows = [], []
            for key, vector in zip(batch.column(0), batch.column(1), strict=True):
                if not key.is_valid or not vector.is_valid or vector.values.null_count:
                    continue
                x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    with np.errstate(over="ignore"):
                        x = np.floor(unit * x)
                    whole = np.where(np.abs(x) < 2.0**63, x, 0).astype("<i8")
                    whole[x >= 2.0**63], whole[x <= -(2.0**63)] = _MOST, -_MOST - 1
                    ids.append(key.as_py())
                    # zeros at the end are the same as none
                    rows.append(whole[: np.flatnonzero(whole)[-1] + 1 if whole.any() else 0].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], names=["id", "v"])

    return run


def _matrix(column) -> np.ndarray:
    """Rows of int64 from a binary column, with zeros up to the longest."""
    values = [x.as_py() for x in column]
    width = max(map(len, values), default=0)
    return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), "<i8").reshape(len(values), width // 8)


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, w - x.shape[1]))) for x in (a, b))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows, cut to the range of a long; by floating point where no sum
    can exceed 53 bits."""
    w = min(q.shape[1], x.shape[1])
    q, x = q[:, :w], x[:, :w]
    # magnitudes as floats: the least long has no positive counterpart
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * w
    if most < 2**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return q @ x.T
    exact = q.astype(object) @ x.T.astype(object)
    return np.clip(exact, -_MOST - 1, _MOST).astype(np.int64).reshape(len(q), len(x))


def choose_pivots(sample: np.ndarray, m: int, seed: int) -> np.ndarray:
    """Centres of k-means from spread-out starts."""
    x = sample.astype(np.float64)
    m = min(m, len(x))
    rng = np.random.default_rng(seed)
    at = [int(rng.integers(len(x)))]
    near = ((x - x[at[0]]) ** 2).sum(1)
    while len(at) < m:
        at.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(1))
    centres = x[at]
    for _ in range(8):
        own = nearest(x, centres)[0]
        centres = np.array([x[own == j].mean(0) if (own == j).any() else c for j, c in enumerate(centres)])
    return centres


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, pivots = _same_width(x.astype(np.float64), pivots)
    d2 = (x**2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(1)
    own = d2.argmin(1)
    return own, np.sqrt(((x - pivots[own]) ** 2).sum(1))


def _assign(pivots: np.ndarray):
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            own, far = nearest(_matrix(batch.column(0)), pivots)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(far), batch.column(1)], names=["cell", "far", "n"])

    return run


@dataclass(frozen=True)
class Layout:
    """Pivots of the query groups and data cells, and what the join does with them."""

    pivots: np.ndarray
    floor: np.ndarray  # of groups: the score that their best reach for sure
    query_radius: np.ndarray
    query_blocks: np.ndarray  # of groups
    data_blocks: np.ndarray  # of cells
    meets: np.ndarray  # groups x cells

    @property
    def copies(self) -> int:
        """Blocks of data and of queries that go to a task together."""
        return int((self.meets * self.query_blocks[:, None] * self.data_blocks).sum())


def lay_out(pivots: np.ndarray, rows: np.ndarray, radius: np.ndarray, queries: np.ndarray, query_radius: np.ndarray, k: int, config: KnnConfig) -> Layout:
    """Bounds from the cells' summaries: rows and radius of the data, number and radius of the queries."""
    norm, inner = np.linalg.norm(pivots, axis=1), pivots @ pivots.T
    slack = norm[:, None] * radius + norm * query_radius[:, None] + query_radius[:, None] * radius
    low, high = inner - slack, inner + slack
    floor = np.full(len(pivots), -np.inf)
    for i in range(len(pivots)):
        order = np.argsort(-low[i])
        enough = np.searchsorted(np.cumsum(rows[order]), k)
        if enough < len(order):
            # beyond a long all scores are one, and no bound may tell them apart
            floor[i] = min(low[i][order[enough]], 2.0**63 * (1 - 1e-6))
    meets = (_reaches(high, floor[:, None]) & (rows > 0)) & (queries > 0)[:, None]
    blocks = lambda n, size: np.ceil(n / size).astype(np.int64)
    return Layout(pivots, floor, query_radius, blocks(queries, config.query_block), blocks(rows, config.data_block), meets)


def _reaches(upper: np.ndarray, floor) -> np.ndarray:
    """Whether an upper bound reaches a score, with room for rounding."""
    return upper + np.abs(upper) * 1e-9 + 1e-3 >= np.where(np.isfinite(floor), floor - np.abs(floor) * 1e-9, -np.inf)


def _replicated(y: Layout):
    """Data rows for each query group that may need them, once for each block of its queries."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x, pivots = _same_width(_matrix(batch.column(0)).astype(np.float64), y.pivots)
            norm, cell = np.linalg.norm(x, axis=1), nearest(x, pivots)[0]
            block = batch.column(2).to_numpy() % y.data_blocks[cell]
            scores = x @ pivots.T
            for i in np.flatnonzero(y.query_blocks):
                at = np.flatnonzero(y.meets[i, cell] & _reaches(scores[:, i] + y.query_radius[i] * norm, y.floor[i]))
                part, n = batch.take(pa.array(at)), len(at)
                for q in range(int(y.query_blocks[i])):
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(pa.array(np.asarray(c).astype(np.int32)) for c in (np.full(n, i), cell[at], block[at], np.full(n, q))),
                            pa.nulls(n, pa.int64()), part.column(0), part.column(1),
                        ],
                        names=["grp", "cell", "block", "qblock", "query", "v", "ids"],
                    )

    return run


def _asked(y: Layout):
    """Query rows, once for each block of the cells that their group meets."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            own, _ = nearest(_matrix(batch.column(0)), y.pivots)
            q = batch.column(2).to_numpy() % y.query_blocks[own]
            for i in np.unique(own):
                at = np.flatnonzero(own == i)
                part, n = batch.take(pa.array(at)), len(at)
                for cell in np.flatnonzero(y.meets[i]):
                    for b in range(int(y.data_blocks[cell])):
                        yield pa.RecordBatch.from_arrays(
                            [
                                *(pa.array(np.asarray(c).astype(np.int32)) for c in (np.full(n, i), np.full(n, cell), np.full(n, b), q[at])),
                                part.column(1), part.column(0), pa.nulls(n, pa.list_(pa.int64())),
                            ],
                            names=["grp", "cell", "block", "qblock", "query", "v", "ids"],
                        )

    return run


def _capped(found: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """The first ``2 k`` of sorted (-score, id), no id more than ``k`` times."""
    out, times = [], Counter()
    for x in found:
        times[x[1]] += 1
        if times[x[1]] <= k:
            out.append(x)
            if len(out) == 2 * k:
                break
    return out


def best(q: np.ndarray, x: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[int, int, int]]:
    """(row of q, id, score) of each query's best ids, ``2 k`` at most; every x has its ids in order."""
    out = []
    if not len(q) or not len(x):
        return out
    first, step = np.array([i[0] for i in ids]), max(1, _SLAB // len(x))
    for begin in range(0, len(q), step):
        for r, s in enumerate(products(q[begin : begin + step], x), begin):
            take = 2 * k
            while True:
                if len(s) > take:
                    bar = np.partition(s, len(s) - take)[len(s) - take]
                    at = np.flatnonzero(s >= bar)
                    at = at[np.lexsort((first[at], -s[at]))[:take]]
                else:
                    at = np.arange(len(s))
                found = _capped(sorted((-int(s[j]), i) for j in at for i in ids[j]), k)
                if len(found) == 2 * k or len(at) == len(s):
                    break
                take *= 4  # many vectors of one id: look further
            out += [(r, i, -s) for s, i in found]
    return out


def _solve(k: int):
    def run(table: pa.Table) -> pa.Table:
        asked = table["query"].is_valid()
        queries, data = table.filter(asked), table.filter(pa.compute.invert(asked))
        found = best(_matrix(queries["v"]), _matrix(data["v"]), data["ids"].to_pylist(), k)
        names = queries["query"].to_numpy()
        rows, ids, scores = (np.array(c, np.int64) for c in (zip(*found, strict=True) if found else ((), (), ())))
        return pa.table({"query": names[rows] if len(rows) else rows, "id": ids, "score": scores})

    return run


def _first(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def exact_top_k(vectors: DataFrame, is_query: Column, config: KnnConfig = KnnConfig(), key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best among all other rows.

    ``is_query`` is a condition on a column named ``id``."""
    plain = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = materialize(plain.mapInArrow(_integers(config.unit), "id long, v binary"), "vectors")
    asked = materialize(rows.filter(is_query).distinct(), "asked")
    k = config.k
    few = _first(_first(rows, ["v", "id"], ["id"], k), ["v"], ["id"], 2 * k)
    points = materialize(
        few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("deal", F.abs(F.xxhash64("v") % (1 << 30))), "points"
    )
    solved = materialize(
        asked.groupBy("v").agg(F.min("id").alias("query")).withColumn("deal", F.abs(F.xxhash64("v", F.lit(1)) % (1 << 30))).select("v", "query", "deal"), "queries"
    )
    n_queries = solved.count()
    if not n_queries:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    m = int(np.clip(-(-n_queries // config.queries_per_pivot), config.min_pivots, config.max_pivots))
    sample = _matrix(points.orderBy(F.xxhash64("v", F.lit(config.seed)), "v").limit(config.pivot_sample).select("v").toArrow()["v"])

    def measured(pivots: np.ndarray) -> Layout:
        def summary(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
            count, radius = np.zeros(len(pivots)), np.zeros(len(pivots))
            cells = df.mapInArrow(_assign(pivots), "cell int, far double, n int").groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far"))
            for r in cells.collect():  # a row for each pivot
                count[r["cell"]], radius[r["cell"]] = r["n"], r["far"] * (1 + 1e-9)
            return count, radius

        # a data point counts once, however many ids it stands for: a lower bound of its rows
        data, queries = summary(points.select("v", F.lit(1).alias("n"))), summary(solved.select("v", F.lit(1).alias("n")))
        return lay_out(pivots, *data, *queries, 2 * k, config)

    layout = measured(choose_pivots(sample, m, config.seed))
    single = -(-n_queries // config.query_block) * -(-points.count() // config.data_block)
    if layout.copies > single:
        layout = measured(choose_pivots(sample, 1, config.seed))
    schema = "grp int, cell int, block int, qblock int, query long, v binary, ids array<long>"
    both = points.select("v", "ids", "deal").mapInArrow(_replicated(layout), schema).unionByName(solved.mapInArrow(_asked(layout), schema))
    local = both.groupBy("grp", "cell", "block", "qblock").applyInArrow(_solve(k), "query long, id long, score long")
    merged = _first(_first(local, ["query", "id"], [F.desc("score")], k), ["query"], [F.desc("score"), "id"], 2 * k)
    named = asked.select(F.col("id").alias("query_id"), "v").join(solved.select("v", "query"), "v").select("query_id", "query")
    own = named.join(merged, "query").filter("id != query_id")
    # an id with several query vectors asks with each of them
    by_rank = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "id")
    own = own.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= k)
    return own.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
