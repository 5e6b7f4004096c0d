"""Exact top-k inner-product search with paged M-trees.

Vectors are dealt to pages by a tree of metric splits that is fitted on a bounded sample (two far vectors, and the
halves nearer to either). Each page holds an M-tree over its own rows, built once and written out: a
node keeps a centre, a covering radius, the distance to its parent's centre and the largest norm below it, a leaf entry its
distance to the leaf's centre. With ``|x|² <= R²`` and ``d(q, x) >= d(q, c) - r``, no vector of a node scores above
``min(q·c + |q| r, (|q|² + R² - (d(q, c) - r)²) / 2)``; before ``d(q, c)`` is known, the stored parent
distance gives ``d(q, c) >= |d(q, p) - d(c, p)|`` and with it a bound that costs nothing, for leaf entries likewise. Nodes are
visited best bound first; one is skipped only when its bound, with a slack for rounding, is below the k-th score found so far,
so results are exact and ties are kept.

Queries go to the pages in blocks of about ``BLOCK``, each broadcast: no vector is copied or moved for them. A block
starts with a safe k-th score from a bounded sample of real candidates, meets one page in ``FIRST`` to raise it, then the
others; a task hands on k rows a query at most.

Scores are exact integers: floats serve where they can hold every product, 64-bit integers beyond, and scores that could
leave 64 bits, or vectors longer than 2 ** 53, raise an OverflowError.

Cases: vectors that are null or hold a null, NaN or infinite component take no part, nor do rows with
a null id; of vectors with different lengths the shared components count; very long vectors are compared whole; ties go to
the smaller id; every row is a candidate for every other row, also for one of its own id, and repeated rows are each a
candidate and each a query; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, read, staged

#: Vectors of a page, pages at most (then they grow), vectors that a task holds at most (then pages are split by hash).
PAGE, MAX_PAGES, MOST = 2048, 16384, 65536
#: Entries of a leaf, sampled vectors for each page, sampled candidates for first bounds.
LEAF, SAMPLE_PER_PAGE, SAMPLE = 32, 4, 1024
#: Queries of a block (about), and one page in so many that a block meets first.
BLOCK, FIRST = 8192, 16


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) for each component x, taken as a double."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(vector: Column) -> Column:
    """Neither null nor with a null, NaN or infinite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two far vectors of ``x``, and for each vector whether it is in the half nearer to the second."""
    away = _distances(x, x.mean(0)[None, :])[:, 0]
    one = x[int(away.argmax())]
    other = x[int(_distances(x, one[None, :])[:, 0].argmax())]
    return np.stack([one, other]), _distances(x, np.stack([one, other]))


def fit_splits(sample: np.ndarray, pages: int) -> list[tuple]:
    """Metric splits (two vectors, offset, near, far) that deal vectors to pages; a child below zero is page ``-child - 1``."""
    nodes: list[tuple] = []
    made = [0]

    def grow(x: np.ndarray, want: int) -> int:
        if want > 1 and len(x) > 1:
            ends, side = _halves(x)
            lean = side[:, 0] - side[:, 1]
            offset = float(np.median(lean))
            far = lean > offset
            if far.any():
                at = len(nodes)
                nodes.append(())
                nodes[at] = (ends, offset, grow(x[~far], want - want // 2), grow(x[far], want // 2))
                return at
        made[0] += 1
        return -made[0]

    grow(sample, pages)
    return nodes


def deal(x: np.ndarray, nodes: list[tuple]) -> np.ndarray:
    """The page of each vector."""
    out = np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))] if nodes else []
    while todo:
        at, rows = todo.pop()
        if at < 0:
            out[rows] = -at - 1
        elif len(rows):
            ends, offset, near, far = nodes[at]
            side = _distances(x[rows], ends)
            beyond = side[:, 0] - side[:, 1] > offset
            todo += [(near, rows[~beyond]), (far, rows[beyond])]
    return out


#: Columns of a tree's nodes before the centre.
_PARENT, _RADIUS, _TO_PARENT, _NORM, _LO, _HI, _LEAF, _CENTRE = range(8)


def build(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An M-tree: (order of the rows, nodes, each row's distance to its leaf's centre); a node's rows are a slice of the order."""
    nodes: list[list] = []
    order, away_ = [], np.zeros(len(vectors))
    todo = [(np.arange(len(vectors)), -1)] if len(vectors) else []
    while todo:
        rows, parent = todo.pop()
        x = vectors[rows]
        centre = x.mean(0)
        away = _distances(x, centre[None, :])[:, 0]
        at, leaf = len(nodes), len(rows) <= LEAF
        to_parent = float(np.linalg.norm(centre - nodes[parent][_CENTRE])) if parent >= 0 else 0.0
        nodes.append([parent, float(away.max()), to_parent, float(np.sqrt((x * x).sum(1).max())), len(order), len(order) + len(rows), float(leaf), centre])
        if leaf:
            away_[len(order) : len(order) + len(rows)] = away
            order += rows.tolist()
        else:
            # Balanced halves, so the depth is logarithmic; the near one comes first, which keeps a node's rows together.
            _, side = _halves(x)
            by = np.argsort(side[:, 0] - side[:, 1], kind="stable")
            half = len(rows) // 2
            todo += [(rows[by[half:]], at), (rows[by[:half]], at)]
    table = np.array([[*n[:_CENTRE], *n[_CENTRE]] for n in nodes]) if nodes else np.zeros((0, _CENTRE))
    return np.array(order, np.int64), table, away_


def products(q: np.ndarray, x: np.ndarray, reach: float) -> np.ndarray:
    """The integer inner products; ``reach`` bounds their absolute values."""
    if reach < 2.0**52:
        return np.rint(q @ x.T).astype(np.int64)
    if reach >= 2.0**62:
        raise OverflowError("inner products of these vectors don't fit into 64 bits")
    return q.astype(np.int64) @ x.astype(np.int64).T


class Block:
    """A block of queries with the best rows found for each so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.norm = np.sqrt((q * q).sum(1))
        self.kth = floor.copy()
        self.best: list[list[tuple[int, int, int]]] = [[] for _ in ids]  # (-score, id, copies), in order

    def offer(self, a: int, scores: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> None:
        best = sorted([*self.best[a], *zip((-scores).tolist(), ids.tolist(), copies.tolist(), strict=True)])[: self.k]
        self.best[a] = best
        if len(best) == self.k:
            self.kth[a] = max(self.kth[a], -best[-1][0])

    def meet(self, nodes: np.ndarray, x: np.ndarray, away: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> int:
        """Searches a page's tree, best bound first; returns how many vectors were multiplied."""
        q, norm, kth, done = self.q, self.norm, self.kth, 0
        top = float(nodes[0, _NORM])
        slack = 1e-6 * (1 + norm * top)
        reach = float(norm.max(initial=0.0) * top)
        if max(top, norm.max(initial=0.0)) >= 2.0**53:
            raise OverflowError("components beyond 2 ** 53 aren't held exactly")
        square = (x * x).sum(1)
        children: dict[int, list[int]] = {}
        for i, parent in enumerate(nodes[:, _PARENT].astype(int).tolist()):
            children.setdefault(parent, []).append(i)
        heap: list[tuple[float, int, np.ndarray, np.ndarray, np.ndarray]] = []

        def push(i: int, active: np.ndarray) -> None:
            if not len(active):
                return
            n = nodes[i]
            dot = q[active] @ n[_CENTRE:]
            d = np.sqrt(np.maximum(norm[active] ** 2 + n[_CENTRE:] @ n[_CENTRE:] - 2 * dot, 0))
            gap = np.maximum(d - n[_RADIUS], 0)
            upper = np.minimum(dot + norm[active] * n[_RADIUS], (norm[active] ** 2 + n[_NORM] ** 2 - gap**2) / 2) + slack[active]
            heapq.heappush(heap, (-float((upper - kth[active]).max()), i, active, d, upper))

        push(0, np.arange(len(q)))
        while heap:
            _, i, active, d, upper = heapq.heappop(heap)
            open_ = upper >= kth[active]
            active, d = active[open_], d[open_]
            if not len(active):
                continue
            if nodes[i, _LEAF]:
                lo, hi = int(nodes[i, _LO]), int(nodes[i, _HI])
                # What the stored distances to the leaf's centre rule out isn't multiplied.
                gap = np.abs(d[:, None] - away[None, lo:hi])
                may = (norm[active, None] ** 2 + square[None, lo:hi] - gap**2) / 2 + slack[active, None] >= kth[active, None]
                some, rows = active[may.any(1)], np.flatnonzero(may.any(0)) + lo
                if not len(some):
                    continue
                score = products(q[some], x[rows], reach)
                done += score.size
                hit = score >= kth[some, None]
                for j in np.flatnonzero(hit.any(1)):
                    a = int(some[j])
                    take = rows[hit[j]]
                    left = copies[take] - ((ids[take] == self.ids[a]) & (x[take] == q[a]).all(1))
                    self.offer(a, score[j][hit[j]][left > 0], ids[take][left > 0], left[left > 0])
                continue
            for c in children.get(i, []):
                n = nodes[c]
                # What the stored distance to the parent already rules out needs no distance of its own.
                gap = np.maximum(np.abs(d - n[_TO_PARENT]) - n[_RADIUS], 0)
                cheap = (norm[active] ** 2 + n[_NORM] ** 2 - gap**2) / 2 + slack[active]
                push(c, active[cheap >= kth[active]])
        return done


_PAGES = "page long, rows int, width int, ids binary, copies binary, vectors binary, away binary, nodes binary"
_FOUND = "no int, vec_id long, score long, copies long"


def paged(base: DataFrame, sample: np.ndarray, n: int) -> DataFrame:
    """One row for each page (see _PAGES) of the vectors (vec_id, v, copies), all of one length."""
    spark = base.sparkSession
    pages = min(MAX_PAGES, -(-n // PAGE))
    splits = spark.sparkContext.broadcast(fit_splits(sample, pages))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(page=deal(_matrix(b["v"]), splits.value) if len(b) else np.zeros(0, np.int64))

    def grown(page: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(page["v"])
        order, nodes, away = build(x)
        column = lambda name: page[name].to_numpy(np.int64)[order].tobytes()
        return pd.DataFrame([(int(page["page"].iloc[0]), len(x), x.shape[1], column("vec_id"), column("copies"), x[order].astype(np.int64).tobytes(), away.tobytes(), nodes.tobytes())], columns=[c.split()[0] for c in _PAGES.split(", ")])

    dealt = staged(base.mapInPandas(route, "vec_id long, v array<long>, copies long, page long"), "dealt")
    sizes = dealt.groupBy("page").agg(F.count("*").alias("size"))  # at most MAX_PAGES rows
    salt = F.pmod(F.xxhash64("vec_id", "v"), F.ceil(F.col("size") / MOST))
    keyed = dealt.join(F.broadcast(sizes), "page").withColumn("salt", salt)
    parts = min(max(1, pages), max(int(spark.conf.get("spark.sql.shuffle.partitions")), pages // 16))
    out = staged(keyed.repartition(parts, "page", "salt").groupBy("page", "salt").applyInPandas(grown, _PAGES), "pages")
    discard(spark, dealt)
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score for integer vectors and queries (vec_id long, v array<long>); queries are rows of the vectors."""
    spark = vectors.sparkSession
    longest = max(1, vectors.agg(F.max(F.size("v"))).first()[0] or 0)
    even = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(longest) - F.size("v"))).alias("v")
    base = staged(vectors.select("vec_id", even).groupBy("vec_id", "v").agg(F.count("*").alias("copies")), "vectors")
    asked = queries.select("vec_id", even).groupBy(F.col("vec_id").alias("query_id"), "v").agg(F.count("*").alias("times"))
    n, blocks = base.count(), max(1, -(-queries.count() // BLOCK))
    # Laid out by block, so that reading one skips the others.
    asked = staged(asked.withColumn("block", F.pmod(F.xxhash64("query_id", "v"), F.lit(blocks)).cast("int")).repartitionByRange("block").sortWithinPartitions("block"), "queries")
    drawn = base.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(1, n // (SAMPLE_PER_PAGE * min(MAX_PAGES, -(-n // PAGE)) + SAMPLE)))) == 0)
    drawn = drawn.orderBy(F.xxhash64("v", "vec_id")).limit(SAMPLE_PER_PAGE * MAX_PAGES + SAMPLE).toPandas()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = _matrix(drawn["v"])
    pages = paged(base, sample if len(sample) else np.zeros((1, longest)), n)
    some, some_ids, some_copies = sample[:SAMPLE], drawn["vec_id"].to_numpy(np.int64)[:SAMPLE], drawn["copies"].to_numpy(np.int64)[:SAMPLE]
    many = pages.count() > FIRST
    early = F.pmod(F.xxhash64("page", "rows"), F.lit(FIRST)) == 0
    answers: list[DataFrame] = []
    for number in range(blocks):
        block = asked.where(F.col("block") == number).toPandas()
        if not len(block):
            continue
        ids, q = block["query_id"].to_numpy(np.int64), _matrix(block["v"])
        first = Block(ids, q, np.full(len(ids), -(1 << 63), np.int64), k)
        if len(some):
            order, nodes, away = build(some)
            first.meet(nodes, some[order], away, some_ids[order], some_copies[order])
        info = spark.createDataFrame(block[["query_id", "times"]].assign(no=np.arange(len(block), dtype=np.int32)), "query_id long, times long, no int")
        found = []
        for which in ([early, ~early] if many else [F.lit(True)]):
            found.append(staged(_meet(pages.where(which), ids, q, first.kth, k), "found"))
            if many and len(found) == 1:  # at most k rows a query
                for r in found[0].groupBy("no").agg(F.collect_list("score").alias("scores")).select("no", F.slice(F.sort_array("scores", asc=False), 1, k).alias("scores")).collect():
                    if len(r["scores"]) == k:
                        first.kth[r["no"]] = max(first.kth[r["no"]], r["scores"][-1])
        each = reduce(DataFrame.union, found).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k)))))
        rank = F.row_number().over(Window.partitionBy("no").orderBy(F.desc("score"), "vec_id")).alias("rank")
        ranked = each.select("no", "vec_id", "score", rank).where(F.col("rank") <= k).join(F.broadcast(info), "no")
        answers.append(staged(ranked.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("time")).drop("time"), "answers"))
        discard(spark, *found)
        if len(answers) >= 32:
            whole = staged(reduce(DataFrame.union, answers), "answers")
            discard(spark, *answers)
            answers = [whole]
    discard(spark, base, asked, pages)
    return reduce(DataFrame.union, answers) if answers else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _meet(pages: DataFrame, ids: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int) -> DataFrame:
    """What a block of queries finds in some pages: k rows at most for each query and task."""
    sent = pages.sparkSession.sparkContext.broadcast((ids, q, kth))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = Block(*sent.value, k)
        for b in batches:
            for r in b.itertuples():
                read_ = lambda x, kind: np.frombuffer(x, kind)
                x = read_(r.vectors, np.int64).reshape(r.rows, r.width).astype(np.float64)
                nodes = read_(r.nodes, np.float64).reshape(-1, _CENTRE + r.width)
                block.meet(nodes, x, read_(r.away, np.float64), read_(r.ids, np.int64), read_(r.copies, np.int64))
        flat = [(no, i, -s, c) for no, best in enumerate(block.best) for s, i, c in best]
        yield pd.DataFrame(flat, columns=["no", "vec_id", "score", "copies"])

    return pages.mapInPandas(run, _FOUND)


def op4_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    vectors = rows.select(F.col("vec_id").cast("long"), quantised(F.col("embedding")).alias("v"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP4_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.row AS row, q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM e q JOIN e c ON q.row <> c.row WHERE q.vec_id % 50 = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
