"""URL verdicts: longest matching rule, else exact list membership by a cascade of Bloom filters.

The cascade is built against the complete universe of keys (every host of the corpus and every parent
domain of one). Level 0 holds the listed keys; level 1 the unlisted keys that level 0 lets through;
level 2 the listed keys that level 1 lets through; and so on until a level lets nothing wrong
through. For a key of the universe the first level that refuses it settles membership: refused by an
even level, it isn't listed; refused by an odd level, it is. So probing needs no join and is exact.

Everything runs as DataFrame expressions. The driver sees the filters' bits only, at most ``MAX_BITS`` a level, which
go into the plan as one constant array; where a level would need more, ``judge`` matches by a semi join instead
(``listed_by_join``), with the same result.

Cases: a null url, or one without ``://``, has an empty host and path, no rule, and verdict allow;
repeated urls are each judged; an empty table or an empty list gives no blocks by the method; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, read, staged

#: Bits a key in a level, hash functions, and the most bits that one level may take (1 MiB, for 800 000 keys).
BITS_PER_KEY, HASHES, MAX_BITS = 10, 4, 1 << 23

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Listed hosts; a listed host covers its subdomains.
LISTED = tuple(
    f"{name}.example.{top}"
    for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for top in ("com", "net", "org")
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and each of its parent domains."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))


def _places(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * HASHES + i)), F.lit(bits)) for i in range(HASHES)]


class TooLarge(ValueError):
    """A level would need more than MAX_BITS."""


def _level(keys: DataFrame, level: int) -> tuple[int, Column] | None:
    """A level's size in bits and its words as one array; None if there are no keys."""
    n = keys.count()
    if not n:
        return None
    bits = 64 * -(-n * BITS_PER_KEY // 64)
    if bits > MAX_BITS:
        raise TooLarge(f"{n} keys need {bits} bits; at most {MAX_BITS} go into the plan")
    place = keys.select(F.explode(F.array(*_places(F.col("key"), level, bits))).alias("place"))
    words = place.groupBy(F.expr("place div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
    have = {r["word"]: r["bits"] for r in words.collect()}
    text = ",".join(str(have.get(i, 0)) for i in range(bits // 64))
    return bits, F.split(F.lit(text), ",").cast("array<bigint>")


def _passes(key: Column, level: int, bits: int, words: Column) -> Column:
    """Whether a level lets a key through."""
    out = F.lit(True)
    for place in _places(key, level, bits):
        word = F.element_at(words, (F.floor(place / 64) + 1).cast("int"))
        out = out & (F.call_function("shiftrightunsigned", word, (place % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return out


def build_cascade(universe: DataFrame, listed: DataFrame) -> list[tuple[int, Column]]:
    """The levels for two DataFrames of one column ``key``; both need not be distinct or disjoint. May raise TooLarge."""
    marked = universe.select("key", F.lit(0).alias("m")).union(listed.select("key", F.lit(1).alias("m")))
    keys = staged(marked.where("key is not null").groupBy("key").agg(F.max("m").alias("m")), "keys")
    levels: list[tuple[int, Column]] = []
    inside, outside = keys.where("m = 1").select("key"), keys.where("m = 0").select("key")
    while True:
        k = len(levels)
        made = _level(inside, k)
        if made is None:
            return levels
        levels.append(made)
        inside, outside = staged(outside.where(_passes(F.col("key"), k, *made)), "level"), inside


def in_cascade(key: Column, levels: list[tuple[int, Column]]) -> Column:
    """Whether a key of the universe is listed."""
    # Past the last level: it let through none of the keys it wasn't made of.
    out = F.lit(len(levels) % 2 == 1)
    for k in reversed(range(len(levels))):
        out = F.when(_passes(key, k, *levels[k]), out).otherwise(F.lit(k % 2 == 1))
    return out


def listed_by_join(hosts: DataFrame, listed: DataFrame) -> DataFrame:
    """The hosts (column ``host``) that are listed or below a listed one, for lists beyond MAX_BITS."""
    keys = hosts.select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("key"))
    return keys.join(listed.select("key").distinct(), "key", "left_semi").select("host").distinct()


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed (the method's answer) of every page's url."""
    host, path = split_url(F.col("url").cast("string"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    universe = urls.select("host").distinct().select(F.explode(suffixes(F.col("host"))).alias("key"))
    try:
        levels = build_cascade(universe, listed)
    except TooLarge:
        hits = listed_by_join(urls.select("host"), listed).select(F.col("host").alias("hit"))
        met = urls.join(hits, F.col("host") == F.col("hit"), "left").withColumn("listed", F.col("hit").isNotNull()).drop("hit")
    else:
        met = urls.withColumn("listed", F.exists(suffixes(F.col("host")), lambda k: in_cascade(k, levels)))
    judged = met.withColumn("rule", rule).withColumn("by_rule", verdict)
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_list).alias("verdict"), "listed")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, LISTED))).alias("key"))
    return judge(read(spark, sf_dir, "pages"), listed)


_LISTED_SQL = ", ".join(f"('{h}')" for h in LISTED)
OP3_SQL = f"""
WITH listed(key) AS (VALUES {_LISTED_SQL}),
rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
),
urls AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
),
hit AS (
  SELECT DISTINCT u.host FROM urls u JOIN listed l ON u.host = l.key OR ends_with(u.host, '.' || l.key)
),
ruled AS (
  SELECT u.*, h.host IS NOT NULL AS listed,
    CASE WHEN (u.host = 'www.example.com' OR ends_with(u.host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (u.host = 'example.com' OR ends_with(u.host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (u.host = 'net' OR ends_with(u.host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (u.host = 'net' OR ends_with(u.host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (u.host = 'com' OR ends_with(u.host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM urls u LEFT JOIN hit h ON u.host = h.host
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM ruled
"""
