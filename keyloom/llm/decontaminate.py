"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items become sequences of canonical words: numbers turn into ``<num>``, units after
a number into ``<unit>``, capitalised words inside a sentence into ``<name>``, everything else is
lower-cased; a sequence with names is also read with its names as plain words, and one with numbers
literally. Windows of ``WINDOW`` canonical words are hashed and hash-joined. A document and an item
that share windows along one diagonal (document place minus item place) share a passage; its slots
must be filled consistently: where the item repeats a number or a name, so must the document, and
different ones must stay different. So a question with other numbers in it is still found, and a
passage whose placeholders merely coincide is not.

A document is contaminated by an item if matched windows of a consistent diagonal cover at least
``RUN`` words, or the whole item if it is shorter. A diagonal that isn't consistent is judged by its stretches
of adjacent windows: a stretch is cut at the slots that contradict others of it, and a piece of as many
words is a leak, as are as many words in a row that agree to the letter. Windows with fewer than
half literal words are only used in the literal reading. An item of fewer than ``MIN_WORDS`` words is too common
to be a passage: it is only found in texts that have no other words.

The benchmark's window hashes are sent to the executors as a first filter while there are at most
``MAX_HASHES``; beyond that every window goes into the join. What passes is joined with the windows and their slots,
which are broadcast only up to ``BROADCAST_WINDOWS`` rows.

Cases: very long texts and items are read whole; of equally long passages either counts, the number is the same;
a null or empty text matches nothing, as does an item without words; repeated items each
match; each text is judged by itself, also where ids are null or repeated; an empty table on either
side gives documents without matches; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, fresh, read, slices, staged

#: Words of a window, words that must be covered, and words below which an item must be the whole text.
WINDOW, RUN, MIN_WORDS = 8, 13, 5
#: Hashes (8 bytes each) that are sent to executors at most, and windows with their slots (below 1 kB each).
MAX_HASHES, BROADCAST_WINDOWS = 4_000_000, 50_000
#: Words whose numbers a task remembers at most (about), and their length; others are hashed each time.
REMEMBERED, LONG = 1 << 17, 64

# Unit words.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms oz ounce ounces lb lbs pound pounds ton tons tonne tonnes "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz "
    "w kw v a j kj n pa kpa k c f percent dollar dollars euro euros cent cents usd eur mph kmh kb mb gb tb meter meters metre metres degree degrees".split()
)
_TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,:/]\d+)*")
_NAME_GAP = re.compile(r"[.!?:;\n\"“„»|]")
NUM, UNIT, NAME = "<num>", "<unit>", "<name>"
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def canonical(text: str | None) -> tuple[list[str], list[str]]:
    """The canonical words of a text, and for each what filled it (empty for literal words)."""
    text = text or ""
    words, slots, last = [], [], 0
    for m in _TOKEN.finditer(text):
        w = m[0]
        first = w[0]
        if first.isdigit():
            words.append(NUM)
            slots.append(w)
        else:
            low = w.lower()
            if words and words[-1] == NUM and low in UNITS and m.start() - last <= 1:
                words.append(UNIT)
                slots.append(low)
            elif first.isupper() and words and len(w) > 1 and w[1:].islower() and not _NAME_GAP.search(text, last, m.start()):
                words.append(NAME)
                slots.append(low)
            else:
                words.append(low)
                slots.append("")
        last = m.end()
    return words, slots


def named(words: list[str], slots: list[str]) -> list[tuple[list[str], list[str]]]:
    """The sequence as it is and, if it has names, once more with the names as plain words.

    So an item is also found where its names were kept but lost their capitals, or others gained them.
    """
    if NAME not in words:
        return [(words, slots)]
    plain = [s if w == NAME else w for w, s in zip(words, slots, strict=True)]
    return [(words, slots), (plain, ["" if w == NAME else s for w, s in zip(words, slots, strict=True)])]


def readings(words: list[str], slots: list[str]) -> list[tuple[list[str], list[str]]]:
    """Those of ``named`` and, if there are numbers, the sequence with whatever filled its slots as plain words."""
    out = named(words, slots)
    return [*out, ([s or w for w, s in zip(words, slots, strict=True)], [""] * len(words))] if NUM in words else out


def word_ids(words: list[str], known: dict[str, int]) -> np.ndarray:
    if len(known) > REMEMBERED:
        known.clear()
    out = []
    for w in words:
        i = known.get(w)
        if i is None:
            i = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 11)
            if len(known) <= REMEMBERED and len(w) <= LONG:
                known[w] = i
        out.append(i)
    return np.array(out, np.uint64)


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """One hash for each window; windows of different widths never share theirs."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = h * _PRIME + ids[k : k + n]
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def item_windows(item_id: int, text: str | None, window: int = WINDOW) -> Iterator[tuple]:
    """(hash, item_id, place, width, n_words, slots) of an item's usable windows."""
    seen = set()
    for words, slots in readings(*canonical(text)):
        width = min(window, len(words))
        hashes = window_hashes(word_ids(words, {}), width) if width else ()
        for p, h in enumerate(hashes):
            if (int(h), p) not in seen and 2 * sum(not x for x in slots[p : p + width]) >= width:
                seen.add((int(h), p))
                yield int(h), item_id, p, width, len(words), slots[p : p + width]


def covered_words(windows: list[tuple[int, list[str], list[str]]], run: int, n_words: int) -> int:
    """Words of a passage that matched windows (item place, item slots, document slots) of one diagonal cover; zero if it is no leak."""
    slots, exact, covered = {}, set(), set()
    for at, item, doc in windows:
        covered.update(range(at, at + len(item)))
        slots.update((at + k, pair) for k, pair in enumerate(zip(item, doc, strict=True)) if pair[0])
        if list(item) == list(doc):
            exact.update(range(at, at + len(item)))

    def contrary(places: set[int]) -> set[int]:
        """Slots whose filling another of the places contradicts."""
        here = {k: slots[k] for k in places if k in slots}
        pairs = set(here.values())
        sides = [Counter(p[i] for p in pairs) for i in (0, 1)]
        return {k for k, (x, y) in here.items() if sides[0][x] > 1 or sides[1][y] > 1}

    def stretches(places: set[int]) -> list[set[int]]:
        out, last = [], None
        for k in sorted(places):
            if last is None or k > last + 1:
                out.append(set())
            out[-1].add(k)
            last = k
        return out

    need, found = min(run, n_words), [len(s) for s in stretches(exact) if len(s) >= run]
    if not contrary(covered):
        found.append(len(covered))
    for stretch in stretches(covered):
        found += [len(s) for s in stretches(stretch - contrary(stretch))]
    return max((n for n in found if n >= need), default=0)


_WINDOWS = "hash long, item_id long, item_at int, width int, n_words int, item_slots array<string>"


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for i, t in zip(b["item_id"], b["text"], strict=True) for r in item_windows(i, t, window)]
            yield pd.DataFrame(rows, columns=["hash", "item_id", "item_at", "width", "n_words", "item_slots"])

    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return items.mapInPandas(run, _WINDOWS)


def text_key() -> Column:
    """One value for each id and text: what a leak belongs to."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.col("text").cast("string")))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """doc_id, item_id, covered (words), key (see ``text_key``) for every document and item that share a consistent passage."""
    spark = docs.sparkSession
    windows = staged(benchmark_windows(benchmark, window), "windows")
    widths = sorted(r["width"] for r in windows.select("width").distinct().collect())  # at most ``window`` of them
    n = windows.select("hash").distinct().count()
    few = n <= MAX_HASHES
    hashes = spark.sparkContext.broadcast(np.sort(windows.select("hash").distinct().toPandas()["hash"].to_numpy(np.int64)) if few else None)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        listed, known = hashes.value, {}
        for b in slices(batches):
            out: list[tuple] = []
            for i, key, text in zip(b["doc_id"], b["key"], b["text"], strict=True):
                words, slots = canonical(text)
                forms = [word_ids(words, known)]
                if names := [k for k, w in enumerate(words) if w == NAME]:
                    # The second reading differs at the names alone.
                    forms.append(forms[0].copy())
                    forms[1][names] = word_ids([slots[k] for k in names], known)
                if NUM in words:
                    # The literal reading differs at every slot.
                    filled_at = [k for k, x in enumerate(slots) if x]
                    forms.append(forms[0].copy())
                    forms[-1][filled_at] = word_ids([slots[k] for k in filled_at], known)
                literal = len(forms) - 1 if NUM in words else None
                seen: set[tuple[int, int]] = set()
                for form, ids in enumerate(forms):
                    for width in widths:
                        if width < MIN_WORDS and width != len(words):
                            continue
                        h = window_hashes(ids, width)
                        if listed is None:
                            at = np.arange(len(h))
                        elif len(h) and len(listed):
                            near = np.minimum(np.searchsorted(listed, h), len(listed) - 1)
                            at = np.flatnonzero(listed[near] == h)
                        else:
                            at = []
                        for p in at:
                            if (int(h[p]), int(p)) not in seen:
                                seen.add((int(h[p]), int(p)))
                                filled = ["" if form == literal or form and words[k] == NAME else slots[k] for k in range(p, p + width)]
                                out.append((i, key, int(h[p]), int(p), filled))
            yield pd.DataFrame(out, columns=["doc_id", "key", "hash", "doc_at", "doc_slots"])

    keyed = docs.select(F.col("doc_id").cast("string"), text_key().alias("key"), F.col("text").cast("string"))
    places = keyed.mapInPandas(found, "doc_id string, key string, hash long, doc_at int, doc_slots array<string>")
    side = F.broadcast(windows) if windows.count() <= BROADCAST_WINDOWS else windows
    met = places.join(side, "hash").withColumn("diagonal", F.col("doc_at") - F.col("item_at"))
    # A document may hold an item many times; each diagonal is judged by itself, windows first pooled
    # by their places so that no group is larger than an item.
    group = ["doc_id", "key", "item_id", "diagonal"]
    by = met.groupBy(*group).agg(F.max("n_words").alias("n_words"), F.collect_set(F.struct("item_at", "item_slots", "doc_slots")).alias("windows"))

    def judge(diagonals: list) -> list:
        return [[covered_words([(w["item_at"], w["item_slots"], w["doc_slots"]) for w in d["windows"]], run, d["n_words"]) for d in diagonals]]

    judged = add_columns(by.select("doc_id", "key", "item_id", F.struct("windows", "n_words").alias("seen")), "seen", "covered int", judge)
    kept = judged.where("covered > 0")
    return kept.groupBy("doc_id", "key", "item_id").agg(F.max("covered").alias("covered")).select("doc_id", "item_id", "covered", "key")


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, contaminated, item_ids (sorted) for every row of ``docs``."""
    hits = staged(matches(docs, benchmark, **options), "leaks").groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    met = docs.select("doc_id", text_key().alias("of")).join(hits, F.col("of") == F.col("key"), "left")
    return met.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a leak, with their columns."""
    leaked = fresh(docs, "__leaked")
    bad = staged(matches(docs, benchmark, **options), "leaks").select(F.col("key").alias(leaked)).distinct()
    return docs.join(bad, text_key() == F.col(leaked), "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.col("contaminated").cast("int").alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), "item_ids")
