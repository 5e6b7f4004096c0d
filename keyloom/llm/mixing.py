"""Mixing sources to target weights by hierarchical budgeting.

Sources are leaves of a tree domain > language > source. The token budget flows down by the weights
of siblings. A leaf can give at most ``max_epochs`` times its tokens; what a node can't use goes first
to its siblings, by their weights, and only what no sibling can take returns to the ancestor's other
children. Budgets are window sums over the tree's nodes, one row each, so a tree may have any number of
leaves. Each leaf then fills its budget with whole epochs and a prefix of one more, in an order
seeded for each epoch: documents are taken while the running token count stays within the budget.

The prefix is found without sorting a leaf in one task: document order is the order of seeded hashes;
hashes fall into ``RANGES`` ranges of ``RANGES`` finer ones each; token sums of the ranges, then of those within the one
in which a leaf's budget ends (small tables), give the finer range in which it does, and only its rows are ordered.

Cases: very long texts are counted whole, and one that doesn't fit ends its leaf's prefix; ties of order go by id
and length; null or empty texts have no tokens and are in every selected prefix they sort into (they cost
nothing); null languages and sources form a leaf named ``unknown``; repeated rows are separate
documents; sources without a domain fall under ``other``; a node whose children all weigh zero splits
evenly, one of no weight gets what its siblings leave; an empty table gives an empty result; other columns are ignored by the operator.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, staged

#: Hash ranges of a leaf on each of two levels, the hashes' span, and the most leaves whose budgets are broadcast.
RANGES, SPAN, BROADCAST_LEAVES = 256, 1 << 60, 100_000


@dataclass(frozen=True)
class Plan:
    """Target weights; what isn't named weighs 1 among its siblings."""

    domains: dict[str, float] = field(default_factory=lambda: {"web": 0.5, "books": 0.3, "code": 0.2})
    languages: dict[str, float] = field(default_factory=lambda: {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1})
    sources: dict[str, float] = field(default_factory=dict)
    #: source -> domain
    domain_of: dict[str, str] = field(default_factory=lambda: {f"src{i}": "web" if i < 10 else "books" if i < 15 else "code" for i in range(20)})
    #: Budget as a share of all tokens, times a leaf may be repeated, seed of the orders.
    share: float = 0.6
    max_epochs: int = 3
    seed: int = 1729


def n_tokens(text: Column) -> Column:
    """Words between white space."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D\x20]+", " "))
    return F.when(flat == "", 0).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("long")


def _weight(name: Column, weights: dict[str, float]) -> Column:
    """A child's weight; what isn't named weighs 1."""
    if not weights:
        return F.lit(1.0)
    known = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in (pair[0], float(pair[1]))])
    return F.coalesce(F.try_element_at(known, name), F.lit(1.0))


def split_budget(children: DataFrame, parent: list[str], child: str, weights: dict[str, float]) -> DataFrame:
    """``children`` (parent, child, room, above) with ``budget``: shares of the parent's budget ``above``.

    Shares go by weight, none beyond a child's ``room``; what a child can't take goes to its siblings. With
    siblings in the order of room by weight, the full ones come first, so running sums find them.
    Children of no weight get what the others leave over, evenly.
    """
    weight = _weight(F.col(child), weights)
    rows = children.withColumn("__tier", (weight <= 0).cast("int")).withColumn("__w", F.when(weight > 0, weight).otherwise(F.lit(1.0)))
    family, tier = Window.partitionBy(*parent), Window.partitionBy(*parent, "__tier")
    first = F.coalesce(F.sum(F.when(F.col("__tier") == 0, F.col("room"))).over(family), F.lit(0.0))
    rows = rows.withColumn("__b", F.when(F.col("__tier") == 0, F.col("above")).otherwise(F.greatest(F.lit(0.0), F.col("above") - first)))
    upto = tier.orderBy(F.col("room") / F.col("__w"), child).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__rooms", F.sum("room").over(upto)).withColumn("__rest", F.sum("__w").over(tier) - F.sum("__w").over(upto))
    full = F.col("__b") >= F.col("__rooms") + F.col("room") / F.col("__w") * F.col("__rest") - 1e-9
    rows = rows.withColumn("__full", full)
    left = F.col("__b") - F.coalesce(F.sum(F.when(F.col("__full"), F.col("room"))).over(tier), F.lit(0.0))
    open_ = F.sum(F.when(~F.col("__full"), F.col("__w"))).over(tier)
    budget = F.when(F.col("__full"), F.col("room")).otherwise(F.greatest(F.lit(0.0), left) * F.col("__w") / open_)
    return rows.withColumn("budget", budget).select(*children.columns, "budget")


def leaf_budgets(sizes: DataFrame, plan: Plan) -> DataFrame:
    """domain, lang, source, n, leaf_budget: the tokens that each leaf is to give, of leaves with n tokens."""
    path = ["domain", "lang", "source"]
    room = (F.lit(plan.max_epochs) * F.sum("n")).cast("double").alias("room")
    above = sizes.agg((F.least(F.lit(plan.share), F.lit(plan.max_epochs)) * F.sum("n")).cast("double").alias("above"))
    for depth, weights in enumerate((plan.domains, plan.languages, plan.sources)):
        children = sizes.groupBy(*path[: depth + 1]).agg(room)
        if depth:
            met = children.join(above, path[:depth])
        else:
            met = children.crossJoin(F.broadcast(above)).withColumn("__all", F.lit(0))  # a single row
        above = split_budget(met, path[:depth] or ["__all"], path[depth], weights).select(*path[: depth + 1], F.col("budget").alias("above"))
    return sizes.join(above, path).select(*path, "n", F.floor(F.col("above") + 1e-6).cast("long").alias("leaf_budget"))


def _domain(source: Column, plan: Plan) -> Column:
    if not plan.domain_of:
        return F.lit("other")
    known = F.create_map(*[F.lit(x) for pair in sorted(plan.domain_of.items()) for x in pair])
    return F.coalesce(F.try_element_at(known, source), F.lit("other"))


def order_key(epoch: Column, row: Column, seed: int) -> Column:
    """The place of a document in an epoch's order: 60 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), row)), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, plan: Plan | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, domain, lang, source, epoch (from 0), tokens, leaf_budget, and the columns in ``carry``: the chosen documents.

    A document is there once for each epoch that takes it.
    """
    plan = plan or Plan()
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    rows = docs.select("doc_id", named("lang").alias("lang"), named("source").alias("source"), n_tokens(F.col("text").cast("string")).alias("tokens"), F.md5(F.col("text").cast("string")).alias("digest"), *carry)
    rows = staged(rows.withColumn("domain", _domain(F.col("source"), plan)), "sized")
    leaf = ["domain", "lang", "source"]
    budgets = leaf_budgets(staged(rows.groupBy(*leaf).agg(F.sum("tokens").alias("n")), "leaves"), plan)
    # A leaf's last epoch is a prefix; the ones before are whole.
    some = F.col("n") > 0
    budgets = budgets.select(*leaf, "leaf_budget", F.when(some, F.expr("leaf_budget div n")).otherwise(0).cast("long").alias("whole"), F.when(some, F.expr("leaf_budget % n")).otherwise(0).cast("long").alias("rest"))
    known = staged(budgets, "budgets")
    few = known.count() <= BROADCAST_LEAVES
    if few:
        known = F.broadcast(known)
    ident = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "digest")

    def ranged(table: DataFrame) -> DataFrame:
        """The table with ``place`` in its leaf's last epoch, and the range of each level that this lies in."""
        return table.withColumn("place", order_key(F.col("whole"), ident, plan.seed)).withColumn("coarse", F.expr(f"place div {SPAN // RANGES}")).withColumn("fine", F.expr(f"place % {SPAN // RANGES} div {SPAN // RANGES // RANGES}"))

    def cut(ranges: DataFrame, level: str, start: Column) -> DataFrame:
        """Of each leaf, the first range that goes beyond the rest: its number (RANGES if none does) and its start."""
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*leaf).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        over = ranges.withColumn("__start", start + before).withColumn("__over", F.col("__start") + F.col("n") > F.col("rest"))
        first = F.min(F.when(F.col("__over"), F.struct(level, "__start"))).alias("f")
        return over.groupBy(*leaf).agg(first).select(*leaf, F.coalesce(f"f.{level}", F.lit(RANGES)).alias(f"{level}_cut"), F.coalesce("f.__start", F.lit(0)).alias(f"{level}_start"))

    def small(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if few else table

    # Two levels of ranges: each window runs over at most RANGES rows a leaf. Only the range in which the budget ends is
    # ordered; of all others the number says whether they are in, so that no text is shuffled.
    some_rows = rows.select("doc_id", "digest", "tokens", *leaf)
    last = ranged(some_rows.join(known, leaf).where("leaf_budget > 0 and rest > 0"))
    coarse = staged(cut(last.groupBy(*leaf, "rest", "coarse").agg(F.sum("tokens").alias("n")), "coarse", F.lit(0)), "coarse")
    met = last.join(small(coarse), leaf).where("coarse = coarse_cut")
    fine = staged(cut(met.groupBy(*leaf, "rest", "coarse_start", "fine").agg(F.sum("tokens").alias("n")), "fine", F.col("coarse_start")), "fine")
    ends = staged(known.join(coarse, leaf, "left").join(fine, leaf, "left").where("leaf_budget > 0"), "ends")
    sized = rows.join(small(ends), leaf)
    placed = ranged(sized.where("rest > 0"))
    inside = placed.where("coarse < coarse_cut or coarse = coarse_cut and fine < fine_cut")
    upto = F.sum("tokens").over(Window.partitionBy(*leaf).orderBy("place", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut_rows = placed.where("coarse = coarse_cut and fine = fine_cut").withColumn("upto", F.col("fine_start") + upto).where("upto <= rest")
    columns = ["doc_id", *leaf, "epoch", "tokens", "leaf_budget", *carry]
    partial = inside.withColumn("epoch", F.col("whole")).select(*columns).union(cut_rows.withColumn("epoch", F.col("whole")).select(*columns))
    full = sized.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1))).select(*columns)
    return full.union(partial)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def _case(column: str, values: dict, otherwise: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items())
    return f"CASE {column} {whens} ELSE {otherwise} END" if values else otherwise


def _level_sql(name: str, parent: list[str], child: str, above: str, weights: dict[str, float], plan: Plan) -> str:
    """A level of the tree in SQL: (path, budget), for positive weights."""
    path, family = ", ".join([*parent, child]), f"PARTITION BY {', '.join(parent) or '1'}"
    weight = _case(child, weights, "1")
    on = f"JOIN {above} a USING ({', '.join(parent)})" if parent else f"CROSS JOIN {above} a"
    upto = f"OVER ({family} ORDER BY room / w, {child} ROWS UNBOUNDED PRECEDING)"
    return f"""{name}_c AS (SELECT {path}, CAST({plan.max_epochs} * sum(n) AS DOUBLE) AS room, CAST({weight} AS DOUBLE) AS w FROM leaves GROUP BY {path}),
{name}_q AS (SELECT c.*, a.budget AS above, sum(room) {upto} AS rooms, sum(w) OVER ({family}) - sum(w) {upto} AS others FROM {name}_c c {on}),
{name}_f AS (SELECT *, above >= rooms + room / w * others - 1e-9 AS filled FROM {name}_q),
{name} AS (SELECT {path}, CASE WHEN filled THEN room ELSE greatest(0, above - coalesce(sum(CASE WHEN filled THEN room END) OVER ({family}), 0)) * w / sum(CASE WHEN NOT filled THEN w END) OVER ({family}) END AS budget FROM {name}_f)"""


def mix_sql(plan: Plan) -> str:
    """``mix`` over the table documents, in SQL."""
    domain = _case("source", {k: f"'{d}'" for k, d in plan.domain_of.items()}, "'other'")
    return f"""
WITH rows_ AS (
  SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D\\x20]+')) AS tokens,
    concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), 'null'), md5(text)) AS ident FROM documents
),
sized AS (SELECT *, {domain} AS domain FROM rows_),
leaves AS (SELECT domain, lang, source, sum(tokens) AS n FROM sized GROUP BY ALL),
total AS (SELECT CAST(least({plan.share}, {plan.max_epochs}) * sum(n) AS DOUBLE) AS budget FROM leaves),
{_level_sql("by_domain", [], "domain", "total", plan.domains, plan)},
{_level_sql("by_lang", ["domain"], "lang", "by_domain", plan.languages, plan)},
{_level_sql("by_source", ["domain", "lang"], "source", "by_lang", plan.sources, plan)},
budgets AS (SELECT l.*, CAST(floor(budget + 1e-6) AS BIGINT) AS leaf_budget FROM leaves l JOIN by_source USING (domain, lang, source)),
met AS (
  SELECT s.*, leaf_budget, CAST(CASE WHEN n > 0 THEN leaf_budget // n ELSE 0 END AS BIGINT) AS whole, CASE WHEN n > 0 THEN leaf_budget % n ELSE 0 END AS rest
  FROM sized s JOIN budgets USING (domain, lang, source) WHERE leaf_budget > 0
),
last AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY substr(md5('{plan.seed}:' || CAST(whole AS VARCHAR) || ':' || ident), 1, 15), doc_id, tokens ROWS UNBOUNDED PRECEDING) AS upto
  FROM met WHERE rest > 0
),
chosen AS (
  SELECT doc_id, domain, lang, source, whole AS epoch, tokens, leaf_budget FROM last WHERE upto <= rest
  UNION ALL SELECT doc_id, domain, lang, source, unnest(range(0, whole)) AS epoch, tokens, leaf_budget FROM met WHERE whole > 0
)
SELECT doc_id, domain, lang, source, CAST(epoch AS BIGINT) AS epoch, CAST(tokens AS BIGINT) AS tokens, leaf_budget FROM chosen
"""


OP9_SQL = mix_sql(Plan())
