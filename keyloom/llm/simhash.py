"""SimHash near-duplicates by vantage-point trees.

1. Each text becomes a 64-bit fingerprint of its word shingles (XXH64, majority per bit).
2. Distinct fingerprints are dealt to the leaves of a vantage-point tree: a node sends those within
   ``mu`` bits of its vantage point to one side and the others to the other side. The tree is fitted
   on a bounded sample; it only decides where work happens, never what is found.
3. A fingerprint whose distance is within ``radius`` of a node's boundary also visits the other
   side, so by the triangle inequality every pair within the radius meets in the home leaf of one of
   the two. Inside a leaf the same recursion goes on in numpy.
4. A leaf returns a spanning set of its links, not all pairs; connected components over all leaves
   come from alternating large-star and small-star rounds in Spark.

Cases: a null text counts as empty; a text without words has fingerprint zero and is linked like any
other; repeated rows are each returned; a row with a null id takes its group's smallest id (null if
the group has none); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns, discard, fresh, packed, scratch, slices, staged

#: Members of a leaf that the tree aims at, and sampled fingerprints for each leaf.
LEAF, SAMPLE_PER_LEAF, MAX_LEAVES = 4096, 24, 65536
#: Cells of a distance matrix that are compared at once.
CELLS = 1 << 21
#: One text in so many is read for the order of shingles; that many common shingles are sent to executors at most.
SAMPLED, MAX_COMMON = 16, 1_000_000
#: Texts to be read again whose keys (about 100 bytes each) are sent to executors at most.
MAX_ASKED = 300_000
#: Texts of one shingle that are dealt to one hand, and how often.
HAND, DEALS = 8, 6
#: Bits of a sieve for each value that it knows, and at most (rounded up to a power of two: 32 MB).
SIEVE, MAX_SIEVE = 16, 1 << 27
_NO_LONGS = np.zeros(0, np.int64)


def shingle_hashes(text: str | None, width: int) -> tuple[bytes, np.ndarray]:
    """The words, joined by spaces, and the XXH64 of each shingle, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    flat = b" ".join(words)
    if len(words) <= width:
        grams = [flat] if words else []
    else:
        ends, at = [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *(e + 1 for e in ends[:-width])]
        grams = [flat[s:e] for s, e in zip(starts, ends[width - 1 :], strict=True)]
    digest = xxhash.xxh64_intdigest
    return flat, np.fromiter((digest(g, 42) for g in grams), np.uint64, len(grams))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; zero if there are none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of one text as an unsigned number."""
    return majority(shingle_hashes(text, width)[1])


def sample_prints(hashes: np.ndarray, samples: int, size: int = 3) -> np.ndarray:
    """SimHashes of ``samples`` min-wise samples of ``size`` distinct shingles."""
    distinct = np.unique(hashes)
    out = np.zeros(samples, np.uint64)
    for t in range(samples if len(distinct) else 0):
        mixed = (distinct ^ np.uint64(0x9E3779B97F4A7C15 * (t + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        least = mixed if len(mixed) <= size else np.partition(mixed, size - 1)[:size]
        out[t] = majority(np.sort(least))
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) of every row."""

    def prints(texts: list) -> list:
        return [np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)]

    return add_columns(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "text", "fp long", prints).select("doc_id", "fp")


def fit_tree(sample: np.ndarray, leaves: int, radius: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, mu, near, far); a child below zero is leaf ``-child - 1``."""
    nodes: list[tuple[int, int, int, int]] = []
    made = [0]

    def leaf() -> int:
        made[0] += 1
        return -made[0]

    def grow(points: np.ndarray, want: int) -> int:
        if want <= 1 or len(points) < 4:
            return leaf()
        best = None
        for vp in points[:: max(1, len(points) // 24)][:24]:
            d = np.bitwise_count(points ^ vp)
            mu = int(np.median(d))
            share = float((d <= mu).mean())
            if 0 < share < 1:
                cost = float((np.abs(d.astype(int) - mu) <= radius).mean()) + abs(share - 0.5)
                if best is None or cost < best[0]:
                    best = (cost, vp, mu, d <= mu)
        if best is None:
            return leaf()
        at = len(nodes)
        nodes.append((0, 0, 0, 0))
        _, vp, mu, near = best
        nodes[at] = (int(vp), mu, grow(points[near], want // 2), grow(points[~near], want - want // 2))
        return at

    grow(sample, leaves)
    return nodes


def deal(fps: np.ndarray, nodes: list[tuple[int, int, int, int]], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (leaf, index, home): each fingerprint at its home leaf and at those it only visits."""
    if not nodes:
        return np.zeros(len(fps), np.int64), np.arange(len(fps)), np.ones(len(fps), bool)
    out, stack = [], [(0, np.arange(len(fps)), np.ones(len(fps), bool))]
    while stack:
        at, idx, home = stack.pop()
        if not len(idx):
            continue
        if at < 0:
            out.append((np.full(len(idx), -at - 1, np.int64), idx, home))
            continue
        vp, mu, near, far = nodes[at]
        d = np.bitwise_count(fps[idx] ^ np.uint64(vp)).astype(np.int16)
        to_near, to_far = d - radius <= mu, d + radius > mu
        stack.append((near, idx[to_near], (home & (d <= mu))[to_near]))
        stack.append((far, idx[to_far], (home & (d > mu))[to_far]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class _Forest:
    """Union-find whose batches of links are merged by repeated minimum and pointer jumping."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (jumped := self.root[self.root]) is not None and not np.array_equal(jumped, self.root):
                self.root = jumped


def _neighbours(fps: np.ndarray, members: np.ndarray, queries: np.ndarray, radius: int, forest: _Forest) -> None:
    """For sets that no vantage point divides: look up every pattern within the radius."""
    order = members[np.argsort(fps[members])]
    keys = fps[order]
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    masks = [np.uint64(0), *one]
    for _ in range(radius - 1):
        masks = list({int(m ^ o): None for m in masks for o in one} | {int(m): None for m in masks})
        masks = [np.uint64(m) for m in masks]
    for m in masks:
        at = np.searchsorted(keys, fps[queries] ^ m)
        at[at == len(keys)] = 0
        hit = keys[at] == fps[queries] ^ m
        forest.link(queries[hit], order[at[hit]])


def link_leaf(fps: np.ndarray, home: np.ndarray, radius: int) -> np.ndarray:
    """For distinct fingerprints of one leaf, the index of each one's component's first member."""
    forest = _Forest(len(fps))
    stack = [(np.flatnonzero(home), np.arange(len(fps)), 0)]
    while stack:
        m, q, stuck = stack.pop()
        if not len(m) or not len(q):
            continue
        if len(m) <= 256 or len(m) * len(q) <= CELLS:
            step = max(1, CELLS // len(m))
            for i in range(0, len(q), step):
                r, c = np.nonzero(np.bitwise_count(fps[q[i : i + step], None] ^ fps[m][None, :]) <= radius)
                forest.link(q[i + r], m[c])
            continue
        if stuck >= 4:
            _neighbours(fps, m, q, radius, forest)
            continue
        vp = fps[m[(len(m) * (stuck + 1)) // 6]]
        dm, dq = (np.bitwise_count(fps[x] ^ vp).astype(np.int16) for x in (m, q))
        mu = int(np.median(dm))
        sides = ((m[dm <= mu], q[dq - radius <= mu]), (m[dm > mu], q[dq + radius > mu]))
        for sm, sq in sides:
            stack.append((sm, sq, stuck + 1 if len(sq) > 0.9 * len(q) else 0))
    return forest.root


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) of edges (u, v), by alternating stars."""
    spark = edges.sparkSession
    with scratch(spark) as keep:
        edges = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        seen = None
        while True:
            state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
            if state == seen or not state[0]:
                return keep(edges).select(F.col("u").alias("node"), F.col("v").alias("root"))
            seen = state
            both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            # Minima are written out before they are joined, so that a node of many edges is joined in slices.
            least = staged(both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m")), "least")
            large = staged(both.join(least, F.col("u") == F.col("w")).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
            low = staged(large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), "low")
            small = large.join(low, F.col("u") == F.col("w")).where("v <> m").select("v", F.col("m").alias("r"))
            old, edges = edges, staged(small.select(F.col("v").alias("u"), F.col("r").alias("v")).union(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct(), "small")
            discard(spark, old, least, large, low)


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """u, v: links among distinct fingerprints (column fp) that join all within ``radius`` bits."""
    spark = distinct.sparkSession
    n = distinct.count()
    leaves = min(MAX_LEAVES, -(-n // LEAF))
    nodes = []
    if leaves > 1:
        every = max(2, n // (leaves * SAMPLE_PER_LEAF))
        sample = [fp for (fp,) in packed(distinct.where(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(every)) == 0).select("fp"))]
        nodes = fit_tree(np.sort(np.concatenate([_NO_LONGS, *sample])).view(np.uint64), leaves, radius)
    tree = spark.sparkContext.broadcast(nodes)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = b["fp"].to_numpy(np.int64)
            leaf, idx, home = deal(fps.view(np.uint64), tree.value, radius)
            yield pd.DataFrame({"leaf": leaf, "fp": fps[idx], "home": home})

    def linked(group: pd.DataFrame) -> pd.DataFrame:
        fps = group["fp"].to_numpy(np.int64)
        root = link_leaf(fps.view(np.uint64), group["home"].to_numpy(bool), radius)
        own = root != np.arange(len(root))
        return pd.DataFrame({"u": fps[own], "v": fps[root[own]]})

    return distinct.select("fp").mapInPandas(dealt, "leaf long, fp long, home boolean").groupBy("leaf").applyInPandas(linked, "u long, v long")


def near_groups(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs`` (doc_id, text)."""
    with scratch(docs.sparkSession) as keep:
        prints = keep(staged(fingerprints(docs, width), "prints"))
        distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
        roots = components(links(distinct, radius))
        rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
        # Written out first: a root of many members is then joined in slices.
        firsts = staged(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "firsts")
        ids = keep(staged(rooted.select("fp", "root").join(firsts, "root").select(F.col("fp").alias("key"), "component_id"), "groups"))
    return prints.join(ids, prints["fp"] == ids["key"], "left").select("doc_id", "fp", "component_id")


def prefix_lengths(n: int, threshold: float) -> tuple[int, int]:
    """How many of a set's ``n`` tokens, in an order that all sets share, a similar set must meet.

    The first is for partners of any size, the second for partners that are no smaller.
    """
    return n - math.ceil(threshold * n - 1e-9) + 1, n - math.ceil(2 * threshold / (1 + threshold) * n - 1e-9) + 1


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that recur in a sample of the texts, sorted, and in how many texts of it: they only order prefixes."""

    def sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            sets = [np.unique(shingle_hashes(t, width)[1]) for t in b["text"]]
            yield pd.DataFrame({"token": np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)})

    some = docs.where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(SAMPLED)) == 0).select(F.col("text").cast("string"))
    counts = staged(some.mapInPandas(sampled, "token long").groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "recurring")
    tokens, n = (np.concatenate(c) for c in zip((_NO_LONGS, _NO_LONGS), *packed(most_frequent(counts, MAX_COMMON)), strict=True))
    discard(docs.sparkSession, counts)
    order = np.argsort(tokens)
    return tokens[order], n[order]


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows (token, n) of the largest n, of equal ones those of the smallest tokens (hashes, each in one row).

    No task and no driver sorts them: the border is found in histograms, by n and then by the tokens' high bits.
    """
    left = most
    by_n = sorted(((r["n"], r["c"]) for r in counts.groupBy("n").agg(F.count("*").alias("c")).collect()), reverse=True)
    if sum(c for _, c in by_n) <= most:
        return counts
    for cut, c in by_n:
        if c > left:
            break
        left -= c
    page = F.shiftright("token", 52)
    tie = counts.where(F.col("n") == cut)
    for border, c in sorted((r["page"], r["c"]) for r in tie.groupBy(page.alias("page")).agg(F.count("*").alias("c")).collect()):
        if c > left:
            break
        left -= c
    inside = np.sort(np.concatenate([t for (t,) in packed(tie.where(page == border).select("token"))]))
    first = (page < border) | (page == border) & (F.col("token") < int(inside[left]))
    return counts.where((F.col("n") > cut) | (F.col("n") == cut) & first)


def rarest_first(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The distinct shingles as longs, those of the fewest texts first, equal ones by value."""
    tokens, counts = np.unique(hashes).view(np.int64), 0
    listed, n = common
    if len(listed):
        at = np.minimum(np.searchsorted(listed, tokens), len(listed) - 1)
        counts = np.where(listed[at] == tokens, n[at], 0)
    return tokens[np.lexsort((tokens, np.broadcast_to(counts, tokens.shape)))]


def sieve(values: DataFrame, n: int) -> np.ndarray:
    """The words of a bit table of about ``n`` values (one column of hashes as longs): it is set at each one's low bits.

    It only spares shuffles: what it lets through is joined exactly. Its size is bounded; beyond that it lets more through.
    """
    words = 1 << max(4, min(MAX_SIEVE, SIEVE * max(n, 1)).bit_length() - 6)
    (value,) = values.columns
    parts = values.groupBy((F.shiftrightunsigned(value, 6).bitwiseAND(F.lit(words - 1))).cast("int").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(`{value}` & 63L as int)))").alias("bits"))
    table = np.zeros(words, np.uint64)
    for word, bits in packed(parts) if n else ():
        table[word] = bits.view(np.uint64)
    return table


def sifted(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the longs the bit table may know."""
    bits = values.view(np.uint64)
    word = (bits >> np.uint64(6)) & np.uint64(len(table) - 1)
    return (table[word.astype(np.int64)] >> (bits & np.uint64(63))) & np.uint64(1) == 1


def maybe_among(rows: DataFrame, key: str, listed: DataFrame, n: int) -> Column:
    """A condition on ``rows``: whether ``key`` may be in the ``listed`` table of one column and ``n`` rows. If it is false, the key isn't."""
    (of,) = listed.columns
    table = rows.sparkSession.sparkContext.broadcast(sieve(listed.select(F.xxhash64(of).alias("h")), n))

    @F.pandas_udf("boolean")
    def known(h: pd.Series) -> pd.Series:
        return pd.Series(sifted(table.value, h.to_numpy(np.int64)))

    return known(F.xxhash64(key))


def prefix_postings(held: DataFrame) -> DataFrame:
    """token, id, n, index, at: the places of shingles in prefixes, but for most shingles that only one text has.

    ``held`` has id, n (shingles), tokens (the prefix, rarest shingles first) and index (how many of them a partner that is
    no smaller must meet). A shingle that pairs can meet in is in several prefixes, in one of them in the index part.
    Only such ones' bits let a place through, so no join has to bring the counts back to all places.
    """
    places = held.select("index", F.posexplode("tokens").alias("at", "token"))
    counts = places.groupBy("token").agg(F.count("*").alias("c"), F.max(F.col("at") < F.col("index")).alias("starts"))
    live = staged(counts.where("c > 1 and starts").select(F.col("token").alias("live")), "live")
    table = held.sparkSession.sparkContext.broadcast(sieve(live, live.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            lists = b.column("tokens")
            sizes, tokens = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            some = np.flatnonzero(sifted(table.value, tokens))
            own = [b.column(c).take(pa.array(row[some])) for c in ("id", "n", "index")]
            yield pa.RecordBatch.from_arrays([pa.array(tokens[some]), *own, pa.array(at[some].astype(np.int32))], names=["token", "id", "n", "index", "at"])

    return staged(held.select("id", "n", "index", "tokens").mapInArrow(run, "token long, id long, n int, index int, at int"), "postings")


def shared_postings(postings: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """The postings of shingles that texts of several roots (id, root) have, with the root, the texts of
    the shingle (c), the class of sizes and whether the root is another than the one with the most of them (minor)."""
    met = staged(postings.join(roots, "id"), "rooted")
    by_root = met.groupBy("token", "root").agg(F.count("*").alias("rows"))
    most = by_root.groupBy(F.col("token").alias("of")).agg(F.max_by("root", F.struct("rows", "root")).alias("most"), F.count("*").alias("roots"), F.sum("rows").alias("c")).where("roots > 1")
    size = F.floor(F.log("n") / -math.log(threshold) + 1e-9).cast("int")
    out = met.join(staged(most.drop("roots"), "most"), F.col("token") == F.col("of"))
    return staged(out.select("token", "id", "root", "n", "index", "at", "c", size.alias("size"), (F.col("root") != F.col("most")).alias("minor")), "shared")


def _fits(threshold: float) -> Column:
    """Whether the texts of two postings (n, at and n_x, at_x) may be similar if this is the first shingle they share."""
    room = F.least(F.col("n_x") - F.col("at_x"), F.col("n") - F.col("at")) >= threshold / (1 + threshold) * (F.col("n_x") + F.col("n")) - 1e-9
    return (F.col("root_x") != F.col("root")) & (F.least("n_x", "n") >= threshold * F.greatest("n_x", "n") - 1e-9) & room


def dealt_candidates(postings: DataFrame, shared: DataFrame, threshold: float) -> DataFrame:
    """x, y: a few pairs at most for each text and shingle, of different roots.

    The texts of a shingle are dealt to hands of about ``HAND`` texts, ``DEALS`` times and for each shingle otherwise, and each text
    meets the best of its hand: one of the largest root, at every other deal one that has few shingles of its prefix for itself. So a
    text of a large group meets a few times as many different members of it as its prefix has shingles, and those from which
    many were copied; when these pairs are joined, few texts are left that ``prefix_candidates`` has to compare with the whole group.
    """
    own = postings.groupBy("id", "n").agg(F.count("*").alias("c")).select("id", (F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1 - F.col("c")).alias("own"))
    dealt = shared.select("token", "id", "root", "n", "at", "minor", "c", F.explode(F.array(*map(F.lit, range(DEALS)))).alias("deal"))
    dealt = dealt.withColumn("hand", F.pmod(F.xxhash64("id", "token", "deal"), F.ceil(F.col("c") / HAND)))
    best = F.min(F.struct("minor", F.when(F.col("deal") % 2 == 0, F.col("own")).alias("own"), F.xxhash64("id", "token", "deal").alias("order"), "id", "root", "n", "at")).alias("f")
    hands = dealt.join(own, "id").groupBy(*[F.col(c).alias(f"{c}_x") for c in ("token", "deal", "hand")]).agg(best)
    first = staged(hands.select("token_x", "deal_x", "hand_x", *[F.col(f"f.{c}").alias(f"{c}_x") for c in ("id", "root", "n", "at")]), "hands")
    same = (F.col("token") == F.col("token_x")) & (F.col("deal") == F.col("deal_x")) & (F.col("hand") == F.col("hand_x"))
    pairs = dealt.where("minor").join(first, same & _fits(threshold))
    return pairs.select(F.greatest("id", "id_x").alias("x"), F.least("id", "id_x").alias("y")).distinct()


def prefix_candidates(shared: DataFrame, threshold: float) -> DataFrame:
    """x, y: all pairs of texts of different roots that may have a similarity of ``threshold``.

    Similar texts meet in a shingle that is in the smaller one's index part and in the larger one's prefix, at places that
    leave room for the shingles they must share (length and positional filter). Pairs of one root are joined already:
    shingles that only one root has are dropped, and of the others the root with the most rows isn't compared with itself.
    """
    # A partner of at most 1 / threshold times the size is in the same class of sizes or the next.
    first = shared.where(F.col("at") < F.col("index")).select(*[F.col(c).alias(f"{c}_x") for c in ("token", "id", "root", "n", "at", "minor")], F.explode(F.array("size", F.col("size") + 1)).alias("size_x"))
    order = (F.col("n_x") < F.col("n")) | (F.col("n_x") == F.col("n")) & (F.col("id_x") < F.col("id"))
    fits = (F.col("token_x") == F.col("token")) & (F.col("size_x") == F.col("size")) & _fits(threshold) & order
    pairs = first.where("minor_x").join(shared, fits).select("id_x", "id").union(first.where("not minor_x").join(shared.where("minor"), fits).select("id_x", "id"))
    return pairs.select(F.greatest("id_x", "id").alias("x"), F.least("id_x", "id").alias("y")).distinct()


def joined_pairs(pairs: DataFrame, held: DataFrame, name: str, value: str, test: Callable[[np.ndarray, np.ndarray, dict], bool], more: tuple[str, ...] = ()) -> DataFrame:
    """The pairs (x, y) whose arrays ``value`` of ``held`` (one row for each ``name``) pass a test."""
    side = lambda to: held.select(F.col(name).alias(to), F.struct(value, *more).alias(f"of_{to}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")

    def run(pairs_: list) -> list:
        return [[test(np.array(p["of_x"][value], np.int64), np.array(p["of_y"][value], np.int64), p) for p in pairs_]]

    checked = add_columns(both.select("x", "y", F.struct("of_x", "of_y").alias("both")), "both", "pass boolean", run)
    return checked.where("pass").select("x", "y")


def agreeing_prefixes(pairs: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """The pairs (x, y) of ids whose prefixes share enough for their whole sets to be similar.

    A shingle of the prefix that ends first can only be shared by way of the other prefix. So the sets share no
    more than the prefixes do and what is behind the longer rest.
    """
    share = threshold / (1 + threshold)

    def test(a: np.ndarray, b: np.ndarray, p: dict) -> bool:
        n, m = p["of_x"]["n"], p["of_y"]["n"]
        return len(np.intersect1d(a, b, assume_unique=True)) + max(n - len(a), m - len(b)) >= share * (n + m) - 1e-9

    wanted = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    return joined_pairs(pairs, held.join(wanted, "id", "left_semi"), "id", "tokens", test, ("n",))


def close_pairs(docs: DataFrame, texts: DataFrame, proposed: DataFrame, width: int, threshold: float) -> DataFrame:
    """u, v: the proposed pairs (node, other) whose whole shingle sets are similar."""
    with scratch(docs.sparkSession) as keep:
        proposed = staged(proposed.where("node <> other").select(F.greatest("node", "other").alias("x"), F.least("node", "other").alias("y")).distinct(), "proposed")
        # Only texts that are proposed are read again: for their whole shingle sets.
        wanted = proposed.select(F.explode(F.array("x", "y")).alias("wanted")).distinct()
        asked = staged(texts.join(wanted, F.col("node") == F.col("wanted"), "left_semi").select("node", F.col("key").alias("of"), "rows"), "asked")

        def sets(texts_: list) -> list:
            return [[np.unique(shingle_hashes(t, width)[1]).view(np.int64) for t in texts_]]

        # Few are asked for as a rule: sending their keys spares the texts a shuffle.
        some, n = docs.select("key", F.col("text").cast("string")), asked.count()
        side = F.broadcast(asked) if n <= MAX_ASKED else asked
        if n > MAX_ASKED:
            some = some.where(maybe_among(some, "key", asked.select("of"), n))
        again = some.join(side, F.col("key") == F.col("of")).select("node", "text", "rows")
        made = staged(add_columns(again, "text", "shingles array<long>", sets).drop("text"), "shingles")
        test = lambda a, b, p: (c := len(np.intersect1d(a, b, assume_unique=True))) >= threshold * (len(a) + len(b) - c)
        close = joined_pairs(proposed, one_each(made, "node"), "node", "shingles", test)
        return keep(staged(close.select(F.col("x").alias("u"), F.col("y").alias("v")), "close"))


def one_each(rows: DataFrame, key: str) -> DataFrame:
    """One row for each ``key``: only those of more than one row are shuffled for it."""
    return rows.where("rows = 1").union(rows.where("rows > 1").dropDuplicates([key]))


def similar_groups(docs: DataFrame, width: int = 5, threshold: float = 0.8, radius: int = 2, samples: int = 4) -> DataFrame:
    """key, node, root of every row: texts whose shingle sets have a Jaccard similarity of ``threshold``.

    ``docs`` has key and text. ``node`` names a text's words, ``root`` its group. A whole text's SimHash
    moves by ten bits or so at a similarity of 0.8, a radius at which no triangle bound prunes. So
    groups are found in steps. First, beside the tree's links within ``radius`` bits, texts are
    proposed that share the SimHash of one of ``samples`` min-wise samples of three shingles, each with
    the first text of its sample's group, and then each with some of the texts that share a shingle of its prefix. Last,
    ``prefix_candidates`` proposes all pairs of different groups that can be similar, so the steps before only save work.
    Every proposal is checked on the whole shingle sets.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        common = spark.sparkContext.broadcast(common_shingles(docs, width))

        def prints(texts: list) -> list:
            nodes, fps, samples_, sizes, index, tokens = [], [], [], [], [], []
            for t in texts:
                words, h = shingle_hashes(t, width)
                ordered = rarest_first(h, common.value)
                nodes.append(hashlib.md5(words).digest())
                fps.append(majority(h))
                samples_.append(sample_prints(h, samples).view(np.int64))
                most, least = prefix_lengths(len(ordered), threshold) if len(ordered) else (0, 0)
                sizes.append(len(ordered))
                index.append(least)
                tokens.append(ordered[:most])
            return [nodes, np.array(fps, np.uint64).view(np.int64), samples_, sizes, index, tokens]

        made = "node binary, fp long, samples array<long>, n int, index int, tokens array<long>"
        rows = staged(add_columns(docs.select("key", F.col("text").cast("string")), "text", made, prints).drop("text"), "rows")
        members = keep(staged(rows.select("key", "node"), "members"))
        # All rows of a node agree in what is made of its words.
        texts = staged(rows.groupBy("node", "fp", "samples", "n").agg(F.min("key").alias("key"), F.count("*").alias("rows")), "texts")
        first = lambda by: F.min(F.struct(F.col("node").alias("other"), F.col("n").alias("m"))).alias(by)
        near = F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-9
        by_print = staged(texts.groupBy("fp").agg(first("f")).select(F.col("fp").alias("print"), "f.*"), "by-print")
        whole = texts.join(by_print, F.col("fp") == F.col("print")).where(near).select("node", "other")
        tree = links(by_print.select(F.col("print").alias("fp")), radius)
        name = lambda fp, node, n: by_print.select(F.col("print").alias(fp), F.col("other").alias(node), F.col("m").alias(n))
        across = tree.join(name("u", "node", "n"), "u").join(name("v", "other", "m"), "v").where(near).select("node", "other")
        sampled = texts.select("node", "n", F.posexplode("samples").alias("t", "s"))
        firsts = staged(sampled.groupBy("t", "s").agg(first("f"), F.count("*").alias("c")).where("c > 1").select("t", "s", "f.*"), "firsts")
        pairs = sampled.join(firsts, ["t", "s"]).where(near).select("node", "other")
        quick = close_pairs(docs, texts, whole.union(across).union(pairs), width, threshold)
        joined = lambda roots: roots.select(F.col("node").alias("member"), "root")
        held = rows.join(texts.select(F.xxhash64("node").alias("id"), F.col("key").alias("of"), "rows"), F.col("key") == F.col("of"))
        held = staged(one_each(held, "id").select("id", "n", "index", "tokens"), "held")
        discard(spark, rows, by_print, firsts)
        postings = prefix_postings(held)
        names = lambda to, name: texts.select(F.xxhash64("node").alias(to), F.col("node").alias(name))

        def shared(links_: DataFrame) -> DataFrame:
            roots = texts.select("node").join(joined(components(links_)), F.col("node") == F.col("member"), "left")
            return shared_postings(postings, staged(roots.select(F.xxhash64("node").alias("id"), F.xxhash64(F.coalesce("root", "node")).alias("root")), "so-far"), threshold)

        def checked(met: DataFrame) -> DataFrame:
            found = staged(agreeing_prefixes(met, held, threshold), "agreeing")
            return close_pairs(docs, texts, found.join(names("x", "node"), "x").join(names("y", "other"), "y").select("node", "other"), width, threshold)

        tried = staged(dealt_candidates(postings, shared(quick), threshold), "dealt")
        quick = quick.union(checked(tried))
        rest = checked(staged(prefix_candidates(shared(quick), threshold).join(tried, ["x", "y"], "left_anti"), "met"))
        roots = components(quick.union(rest))
        out = members.join(joined(roots), F.col("node") == F.col("member"), "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        return keep(staged(out, "grouped"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of similar texts: that of the smallest id, of repeats any one.

    A null id counts as larger than any. Rows and columns are those of ``docs``.
    """
    columns = docs.columns
    key, order = fresh(docs, "__key"), F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64(*columns))
    # Rows that agree in every column have one key.
    keyed = docs.withColumn(key, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex(F.xxhash64(*columns)), F.md5("text")))
    with scratch(docs.sparkSession) as keep:
        groups = similar_groups(keyed.select(F.col(key).alias("key"), "text"), **options)
        ids = keyed.select(F.col(key).alias("id"), order.alias("place")).groupBy("id").agg(F.min("place").alias("place"), F.count("*").alias("n"))
        placed = staged(groups.select("key", "root").distinct().join(ids, F.col("key") == F.col("id")).select("key", "root", "place", "n"), "placed")
        firsts = placed.groupBy("root").agg(F.min(F.struct("place", "key")).alias("first")).select(F.col("root").alias("of"), F.col("first.key").alias("kept"))
        judged = placed.join(staged(firsts, "firsts"), F.col("root") == F.col("of")).select("key", "n", (F.col("key") == F.col("kept")).alias("keep"))
        # Most rows stay: those to go, and the few that stand for repeats, are the small side.
        judged = keep(staged(judged.where("not keep or n > 1"), "judged"))
    other = fresh(keyed, "__other")
    # Rows that the sieve holds back stay: only the others, few more than are judged, are shuffled with their texts.
    maybe = maybe_among(keyed, key, judged.select("key"), judged.count())
    some = keyed.where(maybe)
    once = some.join(judged.select(F.col("key").alias(other)), F.col(key) == F.col(other), "left_anti")
    repeats = some.join(judged.where("keep").select(F.col("key").alias(other)), F.col(key) == F.col(other), "left_semi").dropDuplicates([key])
    return keyed.where(~maybe).select(*columns).union(once.select(*columns)).union(repeats.select(*columns))


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = near_groups(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
