"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

A text becomes a sequence of lower-case words in which numbers, the units behind them and names
(capitalised words inside a sentence) are slots. Hashes of five-word windows of documents meet
those of the benchmark in a hash join; a window with a name is hashed twice, with the name and
with its placeholder. Matches are gathered by document, item and offset. Windows whose slots hold
the item's own values always count; those with a changed slot count if the offset is consistent,
that is, if each value in the item stands for one value in the document. A document leaks an item if the windows cover at least 0.8 of the item's, or 13 words in a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardframe.llm.common import keep

WINDOW = 5
COVERED = 0.8
RUN_WORDS = 13
#: Most benchmark windows that are sent to every executor (about 64 bytes each); beyond, the join
#: is left to Spark.
SENT_WINDOWS = 500_000

# Unit words behind a number.
UNITS = [
    "mm", "cm", "m", "km", "inch", "inches", "ft", "foot", "feet", "yard", "yards", "mile", "miles",
    "meter", "meters", "metre", "metres", "kilometer", "kilometers", "kilometre", "kilometres",
    "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "ton", "tons", "tonne", "tonnes", "lb", "lbs",
    "pound", "pounds", "oz", "ounce", "ounces", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons",
    "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days",
    "week", "weeks", "month", "months", "year", "years", "percent", "degree", "degrees",
    "dollar", "dollars", "cent", "cents", "euro", "euros", "mph", "kmh", "hz", "w", "kw", "v", "kb", "mb", "gb",
]

#: A capitalised word after a word or comma and one space; the mark survives lower-casing.
NAME = r"(?<=[\p{L}\p{N},;] )(\p{Lu}\p{Ll}+)"
MARK = "\ue001"
WORD = MARK + r"?\p{L}[\p{L}\p{M}]*|\p{N}+(?:[.,]\p{N}+)*"


def windows(texts: DataFrame, key: str, text: str = "text", size: int = WINDOW) -> DataFrame:
    """(key, n, pos, hash, slots): the windows of every text; n is the number of its windows.

    `slots` holds the text's own value at each slot of the window, null elsewhere, and is null
    for a window without slots. A text with fewer words has one window, the whole sequence; one
    without words has none.
    """
    marked = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), NAME, MARK + "$1")
    words = texts.select(F.col(key), F.regexp_extract_all(F.lower(marked), F.lit(WORD), F.lit(0)).alias("w"))

    def number(w: Column) -> Column:
        return w < ":"  # words start with a letter or the mark, numbers with a digit

    def unit(w: Column, i: Column) -> Column:
        return (i > 0) & number(F.get(F.col("w"), i - 1)) & w.isin(UNITS)

    def name(w: Column) -> Column:
        return w.startswith(MARK)

    # \p{N} has digits beyond ASCII too; all of them are slots.
    digit = F.exists("w", lambda w: number(w) | name(w) | w.rlike(r"^\p{N}"))
    flagged = words.select(key, "w", digit.alias("slotted"))
    kinds = F.transform("w", lambda w, i: F.when(number(w) | w.rlike(r"^\p{N}"), "#").when(unit(w, i), "%").when(name(w), "@"))
    plain = flagged.select(key, "w", "slotted", F.when(F.col("slotted"), kinds).alias("kind"))
    coded = plain.select(
        key, "w", "slotted", "kind",
        F.when(~F.col("slotted"), F.transform("w", lambda w: F.xxhash64(w)))
        .otherwise(F.transform("w", lambda w, i: F.xxhash64(
            F.when(F.get("kind", i).isin("#", "%"), F.get("kind", i)).otherwise(F.ltrim(w, F.lit(MARK)))))).alias("h"),
        F.when(F.col("slotted"), F.transform("w", lambda w, i: F.xxhash64(F.coalesce(F.get("kind", i), w)))).alias("t"),
    )
    last = F.greatest(F.size("w") - size, F.lit(0))
    at = F.sequence(F.lit(0), last)

    def whole(h: str, i: Column) -> Column:
        return F.xxhash64(*[F.get(F.col(h), i + k) for k in range(size)])

    def any_kind(i: Column, kinds: tuple[str, ...]) -> Column:
        return reduce(Column.__or__, [F.coalesce(F.get("kind", i + k).isin(*kinds), F.lit(False)) for k in range(size)])

    def slots(i: Column) -> Column:
        values = F.array(*[F.when(F.get("kind", i + k).isNotNull(), F.ltrim(F.get("w", i + k), F.lit(MARK))) for k in range(size)])
        return F.when(any_kind(i, ("#", "%", "@")), values)

    none = F.lit(None).cast("array<string>")
    simple = F.transform(at, lambda i: F.struct(i.alias("pos"), whole("h", i).alias("hash"), none.alias("slots")))
    literal = F.transform(at, lambda i: F.struct(i.alias("pos"), whole("h", i).alias("hash"), slots(i).alias("slots")))
    named = F.transform(
        F.filter(at, lambda i: any_kind(i, ("@",))),
        lambda i: F.struct(i.alias("pos"), whole("t", i).alias("hash"), slots(i).alias("slots")))
    each = F.when(~F.col("slotted"), simple).otherwise(F.concat(literal, named))
    rows = coded.filter(F.size("w") > 0).select(key, (last + 1).alias("n"), F.explode(each).alias("x"))
    return rows.select(key, "n", "x.pos", "x.hash", "x.slots")


def leaks(
    docs: DataFrame, benchmark: DataFrame, covered: float = COVERED, run_words: int = RUN_WORDS,
    text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(key, item, n_windows, n_matched, longest_run, changed_slots) for each leaked pair.

    Rows that share a key count as one document; rows without a key are known by their text, so that
    several of them may stand with a null key for one item. Equal items under several ids each count. Null and empty texts, and texts without a letter or digit, match nothing. Items
    shorter than a window match only documents that are just as short. An empty table on either
    side gives an empty result. Further columns are ignored.
    """
    unnamed = F.when(F.col(key).isNull(), F.xxhash64(F.col(text)))
    own = docs.select(F.struct(F.col(key).alias("key"), unnamed.alias("x")).alias("d"), F.col(text).alias("text"))
    asked = keep(windows(benchmark.select(F.col(item).alias("i"), F.col(item_text).alias("text")), "i"), "benchmark")
    asked = asked.select("i", "n", F.col("pos").alias("at"), "hash", F.col("slots").alias("asked"))
    if asked.count() <= SENT_WINDOWS:
        asked = F.broadcast(asked)
    met = windows(own, "d").drop("n").join(asked, "hash")
    pairs = F.when(F.col("slots").isNotNull() & F.col("asked").isNotNull(),
                   F.filter(F.arrays_zip(F.col("asked").alias("a"), F.col("slots").alias("b")), lambda x: x["a"].isNotNull()))
    # On one offset an item's place meets one place of the text: the sets are bounded by the item.
    consistent = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda x: x["a"])))
    runs = (
        met.select("d", "i", "n", "at", (F.col("pos") - F.col("at")).alias("offset"), pairs.alias("pairs"))
        .withColumn("same", F.coalesce(F.forall("pairs", lambda x: x["a"] == x["b"]), F.lit(True)))
        .groupBy("d", "i", "offset")
        .agg(F.max("n").alias("n"), F.collect_set("at").alias("every"), F.collect_set(F.when(F.col("same"), F.col("at"))).alias("same"),
             F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
        .withColumn("at", F.when(consistent, F.col("every")).otherwise(F.col("same")))
        .withColumn("changed", F.when(consistent, F.size(F.filter("pairs", lambda x: x["a"] != x["b"]))).otherwise(0))
        .filter(F.size("at") > 0)
        .withColumn("run", _longest(F.array_sort("at")))
    )
    places = runs.select("d", "i", "n", "run", "changed", F.explode("at").alias("at"))
    once = places.groupBy("d", "i", "at").agg(
        F.max("n").alias("n"), F.max("run").alias("run"), F.max("changed").alias("changed"))
    totals = once.groupBy("d", "i").agg(
        F.max("n").alias("n_windows"), F.count(F.lit(1)).alias("n_matched"),
        (F.max("run") + WINDOW - 1).alias("longest_run"), F.max("changed").alias("changed_slots"))
    enough = (F.col("n_matched") >= covered * F.col("n_windows")) | (F.col("longest_run") >= run_words)
    return totals.filter(enough).withColumn("d", F.col("d.key")).withColumnsRenamed({"d": key, "i": item})


def _longest(places: Column) -> Column:
    """The longest run of consecutive numbers in a sorted array without repeats."""
    start = F.struct(F.lit(-9).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(x == s["last"] + 1, s["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(places, start, step, lambda s: s["best"])


def remove(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """The rows of `docs`, all columns, whose document leaks no item.

    Rows that share a key are one document and go together. Rows without a key are known by
    their text's hash and judged each by itself. Further columns stay as they are; an empty table on
    either side removes nothing."""

    def unnamed(df: DataFrame) -> Column:
        return F.when(df[key].isNull(), F.xxhash64(df[text]))

    marked = docs.select(F.struct(docs[key].alias("key"), unnamed(docs).alias("x")).alias("row"), docs[text].alias("text"))
    bad = leaks(marked, benchmark, key="row", **options).select(
        F.col("row.key").alias("leaking"), F.col("row.x").alias("leaking_x")).distinct()
    same = docs[key].eqNullSafe(bad["leaking"]) & unnamed(docs).eqNullSafe(bad["leaking_x"])
    return docs.join(bad, same, "left_anti")


def oracle() -> str:
    """DuckDB SQL of `leaks` over documents and benchmark, joined on the windows' words."""
    units = ", ".join(f"'{u}'" for u in UNITS)

    def side(table: str, key: str, name: str) -> str:
        mark = r"regexp_replace({}, '([\p{{L}}\p{{N}},;] )(\p{{Lu}}\p{{Ll}}+)', '\1' || chr(57345) || '\2', 'g')"
        marked = mark.format(mark.format("coalesce(text, '')"))
        return rf"""
{name}_w AS (SELECT {key} AS k, regexp_extract_all(lower({marked}), '\x{{E001}}?\p{{L}}[\p{{L}}\p{{M}}]*|\p{{N}}+(?:[.,]\p{{N}}+)*') AS w FROM {table}),
{name}_k AS (SELECT k, w, list_transform(range(1, len(w) + 1), lambda i:
    CASE WHEN regexp_matches(w[i], '^\p{{N}}') THEN '#'
         WHEN i > 1 AND w[i - 1] < ':' AND w[i] IN ({units}) THEN '%'
         WHEN starts_with(w[i], chr(57345)) THEN '@' END) AS c FROM {name}_w WHERE len(w) > 0),
{name}_p AS (SELECT k, greatest(len(w) - {WINDOW}, 0) + 1 AS n, unnest(range(0, greatest(len(w) - {WINDOW}, 0) + 1)) AS pos, w, c FROM {name}_k),
{name}_x AS (SELECT k, n, pos,
    list_transform(range(pos + 1, least(pos + {WINDOW}, len(w)) + 1), lambda i: CASE WHEN c[i] IN ('#', '%') THEN c[i] ELSE ltrim(w[i], chr(57345)) END) AS literal,
    list_transform(range(pos + 1, least(pos + {WINDOW}, len(w)) + 1), lambda i: coalesce(c[i], w[i])) AS template,
    list_transform(range(pos + 1, least(pos + {WINDOW}, len(w)) + 1), lambda i: CASE WHEN c[i] IS NOT NULL THEN ltrim(w[i], chr(57345)) END) AS slots FROM {name}_p),
{name} AS (SELECT k, n, pos, literal AS words, slots FROM {name}_x
    UNION ALL SELECT k, n, pos, template, slots FROM {name}_x WHERE list_contains(template, '@'))"""

    return f"""WITH {side("documents", "doc_id", "d")}, {side("benchmark", "item_id", "b")},
met AS (SELECT d.k AS doc_id, b.k AS item_id, b.n, b.pos AS q, d.pos - b.pos AS o, b.slots AS asked, d.slots AS slots
    FROM d JOIN b ON d.words = b.words),
pairs AS (SELECT DISTINCT doc_id, item_id, o, asked[i] AS a, slots[i] AS v FROM met, range(1, {WINDOW} + 1) r(i) WHERE asked[i] IS NOT NULL),
slotted AS (SELECT doc_id, item_id, o, count(*) = count(DISTINCT a) AS good, count(*) FILTER (a <> v) AS changed FROM pairs GROUP BY ALL),
held AS (SELECT DISTINCT m.doc_id, m.item_id, m.n, m.q, m.o, coalesce(s.changed, 0) AS changed FROM met m
    LEFT JOIN slotted s ON m.doc_id IS NOT DISTINCT FROM s.doc_id AND m.item_id IS NOT DISTINCT FROM s.item_id AND m.o = s.o WHERE coalesce(s.good, true)),
islands AS (SELECT *, q - row_number() OVER (PARTITION BY doc_id, item_id, o ORDER BY q) AS island FROM held),
runs AS (SELECT doc_id, item_id, o, island, count(*) AS run FROM islands GROUP BY ALL),
best AS (SELECT doc_id, item_id, max(run) AS run FROM runs GROUP BY ALL)
SELECT h.doc_id, h.item_id, max(h.n) AS n_windows, count(DISTINCT h.q) AS n_matched, max(b.run) + {WINDOW - 1} AS longest_run, max(h.changed) AS changed_slots
FROM held h JOIN best b ON h.doc_id IS NOT DISTINCT FROM b.doc_id AND h.item_id IS NOT DISTINCT FROM b.item_id
GROUP BY h.doc_id, h.item_id
HAVING count(DISTINCT h.q) >= {COVERED} * max(h.n) OR max(b.run) + {WINDOW - 1} >= {RUN_WORDS}"""
