"""Nearest neighbours and overlap between two sets of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .persist import cut

#: Vectors of one block of either side.
BLOCK = 4096
#: Cells of an index at most, vectors of one on average, and vectors that centres are fitted on.
MOST_CELLS, CELL, FIT_ROWS = 2048, 1024, 32_768
#: Cosines that a task holds at once, and rows that it returns at once.
STRIP, ROWS = 1 << 18, 4096
#: What rounding can add to a cosine, and to the angles of a bound.
ROUNDING = 1e-5
NEIGHBOURS = "query_id long, base_id long, cosine double"


def unit(vectors: pd.Series) -> np.ndarray:
    """Rows of length 1; of zero vectors, 0."""
    if not len(vectors):
        return np.zeros((0, 1))
    v = np.array(vectors.tolist(), float).reshape(len(vectors), -1)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def strips(n: int, width: int) -> Iterator[slice]:
    """Slices of n rows with at most STRIP values of ``width`` in a row (one row at least)."""
    step = max(1, STRIP // max(width, 1))
    return (slice(at, min(at + step, n)) for at in range(0, n, step))


def _best(c: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest of each row that reach its ``least``; of equals the first
    columns. NaN is never among them."""
    c[np.isnan(c)] = -3
    if k < c.shape[1]:
        least = np.maximum(least, np.partition(c, c.shape[1] - k, axis=1)[:, c.shape[1] - k])
    row, col = np.nonzero(c >= least[:, None])
    order = np.lexsort((col, -c[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep]


def _product(k: int):
    """The k best of a block of base rows for each query in a block, by matrix products of strips of
    the queries; of these only the ones that reach the query's ``least``, where it has one."""

    def product(rows: pd.DataFrame) -> pd.DataFrame:
        queries, base = (rows[rows["is_query"] == want].sort_values("id") for want in (True, False))
        if queries.empty or base.empty:
            return pd.DataFrame({"query_id": [], "base_id": [], "cosine": []})
        q, b, ids, base_ids = unit(queries["vec"]), unit(base["vec"]).T, queries["id"].to_numpy(), base["id"].to_numpy()
        least = queries["least"].to_numpy() if "least" in queries else np.full(len(queries), -2.0)
        found = []
        for some in strips(len(q), b.shape[1]):
            c = np.round(q[some] @ b, 6)
            row, col = _best(c, k, least[some])
            found.append((ids[some][row], base_ids[col], c[row, col]))
        return pd.DataFrame(dict(zip(("query_id", "base_id", "cosine"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return product


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "base_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def cosine_topk(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, base_id, cosine) of the k nearest of ``base`` for rows (id, vec); cosines
    are rounded to 6 places first, ties go to the smaller id.

    Both sides are dealt into blocks; each pair of blocks is a task's work that keeps k neighbours
    of each query, so a task holds two blocks and a strip of their cosines and no pair table is made.
    """

    def blocks(df: DataFrame, name: str) -> tuple[DataFrame, int]:
        n = max(1, -(-df.count() // BLOCK))
        return df.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(name), "id", "vec"), n

    (q, nq), (b, nb) = blocks(queries, "qb"), blocks(base, "bb")
    q = q.withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))).withColumn("is_query", F.lit(True))
    b = b.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).withColumn("is_query", F.lit(False))
    return _ranked(q.unionByName(b).groupBy("qb", "bb").applyInPandas(_product(k), NEIGHBOURS), k)


class CellIndex:
    """An inverted file over unit vectors whose search is exact.

    Vectors lie in the cell of the nearest of some centres, which are fitted on FIT_ROWS vectors at
    most; every vector is in a cell. A cell's radius is the largest angle between its centre and its
    vectors, so none of them is nearer to a query than the angle to the centre less the radius. A
    search takes the k-th cosine within the query's own cell and then looks only into cells that can
    reach it. Cells are cut into blocks, so a cell with a third of all vectors is many tasks.
    """

    def __init__(self, base: DataFrame, cells: int | None = None):
        rows = base.filter("vec is not null").select(F.col("id").cast("long").alias("id"), "vec")
        n = rows.count()
        self.n = n
        some = rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).toPandas()
        self.centres = fit_centres(unit(some["vec"]), min(MOST_CELLS, max(1, n // CELL) if cells is None else cells))
        self.rows = cut(self._placed(rows))
        # a row for each of MOST_CELLS cells at most
        facts = self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).toPandas()
        self.size, self.radius = np.zeros(len(self.centres), int), np.full(len(self.centres), -np.inf)
        self.size[facts["cell"]], self.radius[facts["cell"]] = facts["n"], facts["radius"]

    def _placed(self, rows: DataFrame) -> DataFrame:
        centres = self.centres

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for some in it:
                cell, c = _nearest(unit(some["vec"]), centres)
                yield some.assign(cell=cell, angle=np.arccos(c))

        return rows.mapInPandas(run, f"id long, vec {rows.schema['vec'].dataType.simpleString()}, cell int, angle double")

    def _compared(self, pairs: DataFrame, k: int) -> DataFrame:
        """The k best in a cell for ``pairs`` (id, vec, cell, least), if they reach the cosine
        ``least``. Both sides of a cell are cut into blocks, every pair of which is a task's work."""
        size = F.array(*[F.lit(max(1, -(-int(n) // BLOCK))) for n in self.size])
        # a row for each cell at most
        asked = F.broadcast(pairs.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_parts")))
        part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        some, base = (d.select("id", "vec", "cell", least).join(asked, "cell").withColumn("_size", F.get(size, F.col("cell"))) for d, least in ((pairs, F.col("least")), (self.rows, F.lit(0.0).alias("least"))))
        q = some.withColumn("qb", part(F.col("_parts"))).withColumn("bb", every(F.col("_size"))).withColumn("is_query", F.lit(True))
        b = base.withColumn("bb", part(F.col("_size"))).withColumn("qb", every(F.col("_parts"))).withColumn("is_query", F.lit(False))
        return q.unionByName(b).drop("_parts", "_size").groupBy("cell", "qb", "bb").applyInPandas(_product(k), NEIGHBOURS)

    def _others(self, asked: DataFrame) -> DataFrame:
        """(id, vec, cell, least): the cells besides its own that can hold one of the k nearest of a query,
        from (id, vec, cell, least), where ``least`` is the k-th cosine that it has found."""
        run = _reaching(self.centres, self.radius, self.size > 0)
        return asked.mapInPandas(run, f"id long, vec {asked.schema['vec'].dataType.simpleString()}, cell int, least double")

    def search(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """The same rows as ``cosine_topk``, and the (id, cell) that were compared for them. Query
        ids are distinct; null vectors find nothing and aren't found."""
        if not self.n:
            none = queries.sparkSession.createDataFrame([], NEIGHBOURS)
            return _ranked(none, k), none.select(F.col("query_id").alias("id"), F.lit(0).alias("cell"))
        asked = cut(self._placed(queries.filter("vec is not null").select(F.col("id").cast("long").alias("id"), "vec")))
        near = cut(_ranked(self._compared(asked.withColumn("least", F.lit(-2.0)), k), k))
        least = near.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("cosine").alias("least"))
        others = cut(self._others(asked.join(least, "id", "left").select("id", "vec", "cell", F.coalesce("least", F.lit(-2.0)).alias("least"))))
        far = self._compared(others, k)
        return _ranked(near.drop("rank").unionByName(far), k), asked.select("id", "cell").unionByName(others.select("id", "cell"))


def _nearest(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centre of the largest cosine for each row, and that cosine within [-1, 1]."""
    cell, best = np.zeros(len(v), int), np.full(len(v), -1.0)
    for some in strips(len(v), len(centres)):
        c = np.clip(v[some] @ centres.T, -1, 1)
        cell[some], best[some] = c.argmax(axis=1), c.max(axis=1, initial=-1)
    return cell, best


def _reaching(centres: np.ndarray, radius: np.ndarray, filled: np.ndarray):
    """For rows (id, vec, cell, least) a row for each other cell that can reach ``least``, in frames of
    ROWS at most: a query that can skip nothing reaches every cell."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in it:
            v, ids, vec, own, least = unit(some["vec"]), *(some[c].to_numpy() for c in ("id", "vec", "cell", "least"))
            for part in strips(len(v), len(centres)):
                angle = np.arccos(np.clip(v[part] @ centres.T, -1, 1))
                most = np.cos(np.clip(angle - np.where(filled, radius, 0) - ROUNDING, 0, np.pi))
                reach = filled & (most >= least[part][:, None] - ROUNDING)
                reach[np.arange(len(reach)), own[part]] = False
                at, cell = np.nonzero(reach)
                for a in range(0, len(at), ROWS):
                    which = part.start + at[a : a + ROWS]
                    yield pd.DataFrame({"id": ids[which], "vec": vec[which], "cell": cell[a : a + ROWS].astype("int32"), "least": least[which]})

    return run


def fit_centres(v: np.ndarray, cells: int, steps: int = 6) -> np.ndarray:
    """Unit centres by spherical k-means from evenly taken rows; without rows one zero centre."""
    if not len(v):
        return np.zeros((1, max(v.shape[1], 1)))
    centres = v[np.linspace(0, len(v) - 1, min(cells, len(v))).astype(int)]
    for _ in range(steps):
        own = _nearest(v, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centres)
    return centres


def overlap_status(cosine: Column, same_group: Column, likely: float, possible: float) -> Column:
    """Levels in order: direct, possible, candidate, unseen; on rounded cosines."""
    return F.when(same_group, "direct").when(cosine >= likely, "possible").when(cosine >= possible, "candidate").otherwise("unseen")


def best_match(rows: DataFrame) -> DataFrame:
    """(query_id, base_id, score) with the largest score (cosine + min(ratio, 1)) / 2; of equals the
    first rank."""
    score = F.round((F.col("cosine") + F.least(F.col("ratio"), F.lit(1.0))) / 2, 6)
    some = rows.withColumn("score", score)
    best = some.groupBy("query_id").agg(F.max_by(F.struct("base_id", "score"), F.struct("score", -F.col("rank"))).alias("b"))
    return best.select("query_id", "b.base_id", "b.score")

