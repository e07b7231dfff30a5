"""Quality rules whose limits come from quantile sketches of each language and source, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import WORD, grid, grid_floor, join_small, let, set_aside, whole_text

#: Measure: what is counted, per how many of what.
MEASURES = {
    "symbols": ("n_symbols", "n_words", 10_000),
    "dup_lines": ("n_dup_lines", "n_lines", 1_000),
    "repeats": ("n_repeat_words", "n_words", 1_000),
    "word_length": ("word_chars", "n_words", 100),
}
#: The quantiles, in per cent, from which spreads are taken: lower tail, middle, upper tail.
LOWER, MIDDLE, UPPER = 10, 50, 90
#: A limit lies this many spreads, between tail and middle, beyond the tail.
SPREADS = 3
#: A document's own count must lie beyond a limit by this many of its counting errors.
ERRORS = 3
#: A group's sketch has so many more documents of its language, and of all, mixed in.
LANGUAGE_PRIOR, OVERALL_PRIOR = 20, 5
#: A document of a sketch weighs this much, so that shares of one are whole numbers.
UNIT = 1_000


def _repeated(words: Column) -> Column:
    """Words that lie in 3-word windows found twice or more."""
    last = F.size(words) - 3
    windows = F.when(
        last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(places: Column) -> Column:
        # A window adds the words up to the next one, three at most.
        steps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def placed(found: Column) -> Column:
        # Equal windows stand together once sorted; keep those with a neighbour like them.
        twin = F.filter(
            found,
            lambda x, i: F.coalesce(F.get(found, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(found, i + 1)["h"] == x["h"], F.lit(False)),
        )
        return let(F.sort_array(F.transform(twin, lambda x: x["p"])), covered)

    def count(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(pairs), placed))

    return let(windows, count)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words, without the text.

    Counted over the whole text; a null text has no words. Columns of these names
    are replaced.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    whole = whole_text(text)
    by_words = let(
        F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(F.size(w).alias("n"), F.char_length(F.array_join(w, "")).alias("chars"), _repeated(w).alias("repeated")),
    )
    by_lines = let(
        F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("same")),
    )
    symbols = F.char_length(whole) - F.char_length(F.regexp_replace(whole, r"[#*$%&|<>]", ""))
    aside, give_back = set_aside(docs, text)
    kept = aside.withColumns({"_words": by_words, "_lines": by_lines, "_symbols": symbols}).drop(text, *names)
    values = ("_words.n", "_words.chars", "_symbols", "_lines.n", "_lines.same", "_words.repeated")
    made = [F.col(v).cast("bigint").alias(n) for n, v in zip(names, values, strict=True)]
    return give_back(kept.select("*", *made).drop("_words", "_lines", "_symbols"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _value(name: str) -> Column:
    part, whole, per = MEASURES[name]
    return F.floor(F.col(part) * per / F.greatest(F.col(whole), F.lit(1))).cast("bigint")


def _sure(name: str, side: int) -> Column:
    """The value of a measure if its count was lower (-1) or higher (1) by its counting errors."""
    part, whole, per = MEASURES[name]
    count = F.col(part).cast("double")
    return (count + side * ERRORS * F.sqrt(count)) * per / F.greatest(F.col(whole), F.lit(1))


def sketches(measured: DataFrame) -> DataFrame:
    """Counts by language, source, measure and bin of the grid: they merge by addition."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), grid(_value(m)).alias("bin")) for m in MEASURES]))
    return measured.select("lang", "source", each.alias("x")).groupBy("lang", "source", "x.measure", "x.bin").agg(F.count(F.lit(1)).alias("n"))


def _shares(counts: DataFrame, keys: list[str], documents: int) -> DataFrame:
    """The sketch of each key, scaled down or up to so many documents: keys, measure, bin, weight."""
    merged = counts.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    merged = merged.withColumn("total", F.sum("n").over(Window.partitionBy(*keys, "measure")))
    scaled = merged.withColumn("weight", F.expr(f"n * {documents * UNIT}L div total"))
    return scaled.select(*keys, "measure", "bin", "weight").where("weight > 0")


def blended(counts: DataFrame) -> DataFrame:
    """Sketches of every language and source with those of the language and of all mixed in: lang, source, measure, bin, weight.

    So a group of few documents is mostly its language, a group of many itself,
    without a number from which on it is one or the other.
    """
    groups = counts.select("lang", "source", "measure").distinct()
    by_lang = _shares(counts, ["lang"], LANGUAGE_PRIOR).withColumnsRenamed({"lang": "of_lang", "measure": "of"})
    overall = _shares(counts, [], OVERALL_PRIOR).withColumnRenamed("measure", "of")
    same = F.col("measure") == F.col("of")
    names = ["lang", "source", "measure", "bin", "weight"]
    own = counts.withColumn("weight", F.col("n") * UNIT).select(*names)
    language = groups.join(by_lang, same & F.col("lang").eqNullSafe(F.col("of_lang"))).select(*names)
    # Broadcast are the bins of one grid for each measure, at most 64 + 32 * 57 of them.
    everywhere = groups.join(F.broadcast(overall), same).select(*names)
    together = own.unionByName(language).unionByName(everywhere)
    return together.groupBy("lang", "source", "measure", "bin").agg(F.sum("weight").alias("weight"))


def thresholds(counts: DataFrame) -> DataFrame:
    """Low and high limit of every measure for every language and source, from the tails of its blended sketch.

    ``high`` lies ``SPREADS`` times the distance from the middle to the upper tail
    beyond that tail, ``low`` likewise at the other end: nothing but the sketch
    says how wide they are.
    """
    group = Window.partitionBy("lang", "source", "measure")
    weighed = blended(counts).withColumn("total", F.sum("weight").over(group)).withColumn("upto", F.sum("weight").over(group.orderBy("bin")))
    value = grid_floor(F.col("bin"))
    at = {q: F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, value)).alias(f"q{q}") for q in (LOWER, MIDDLE, UPPER)}
    found = weighed.groupBy("lang", "source", "measure").agg(*at.values())
    low, middle, high = (F.col(f"q{q}") for q in (LOWER, MIDDLE, UPPER))
    found = found.select("lang", "source", "measure", (low - SPREADS * (middle - low)).alias("low"), (high + SPREADS * (high - middle)).alias("high"))
    limit = [F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}") for m in MEASURES for side in ("low", "high")]
    return found.groupBy("lang", "source").agg(*limit)


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row, without its text, with the measures, base_failed and kept.

    Sketches cover all documents that pass the base rules. A document is kept if
    it passes these and no measure lies beyond its group's limits by more than the
    counting errors of the document, three times the root of a count: a short text
    with a symbol or two isn't judged by its high share. Word length has a lower
    limit, too. Null language or source is a group of its own. Columns called like
    a result are replaced, all others pass through.
    """
    aside, give_back = set_aside(docs, id_col, text, "lang", "source")
    measured = materialise(measure(aside, text).withColumn("base_failed", base_failed()), "measures")
    limits = thresholds(materialise(sketches(measured.where(~F.col("base_failed"))), "sketches"))
    judged = join_small(measured, limits, ["lang", "source"], [id_col])
    beyond = F.lit(False)
    for m in MEASURES:
        beyond |= F.coalesce(_sure(m, -1) > F.col(f"{m}_high"), F.lit(False))
    beyond |= F.coalesce(_sure("word_length", 1) < F.col("word_length_low"), F.lit(False))
    drop = [f"{m}_{side}" for m in MEASURES for side in ("low", "high")]
    return give_back(judged.withColumn("kept", ~F.col("base_failed") & ~beyond).drop(*drop))


def _sql() -> str:
    value = {m: f"CAST(floor({p} * {per} / greatest({w}, 1)) AS BIGINT)" for m, (p, w, per) in MEASURES.items()}
    bins = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {v} AS v FROM measured WHERE NOT base_failed" for m, v in value.items())

    def sure(m: str, sign: str) -> str:
        part, whole, per = MEASURES[m]
        return f"(CAST({part} AS DOUBLE) {sign} {ERRORS} * sqrt({part})) * {per} / greatest({whole}, 1)"

    def quantile(q: int) -> str:
        return f"min(CASE WHEN upto * 100 >= total * {q} THEN g END) AS q{q}"

    sides = {"low": f"q{LOWER} - {SPREADS} * (q{MIDDLE} - q{LOWER})", "high": f"q{UPPER} + {SPREADS} * (q{UPPER} - q{MIDDLE})"}
    limits = ", ".join(f"max(CASE WHEN measure = '{m}' THEN {e} END) AS {m}_{side}" for m in MEASURES for side, e in sides.items())
    beyond = [f"coalesce({sure(m, '-')} > {m}_high, false)" for m in MEASURES]
    beyond = " OR ".join([*beyond, f"coalesce({sure('word_length', '+')} < word_length_low, false)"])
    return rf"""
WITH split AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM split WHERE len(w) > 2),
grams AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS n FROM spots),
repeated AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM grams WHERE n > 1) GROUP BY doc_id),
measured AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (
    SELECT s.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
           CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
    FROM split s LEFT JOIN repeated r ON s.doc_id = r.doc_id)),
raw AS ({bins}),
binned AS (
  SELECT lang, source, measure, CAST(floor(v / power(2, s)) AS BIGINT) * CAST(power(2, s) AS BIGINT) AS g
  FROM (SELECT *, greatest(length(bin(v)) - 6, 0) AS s FROM raw)),
counts AS (SELECT lang, source, measure, g, count(*) AS n FROM binned GROUP BY lang, source, measure, g),
by_lang AS (
  SELECT lang, measure, g, n * {LANGUAGE_PRIOR * UNIT} // sum(n) OVER (PARTITION BY lang, measure) AS weight
  FROM (SELECT lang, measure, g, sum(n) AS n FROM counts GROUP BY lang, measure, g)),
overall AS (
  SELECT measure, g, n * {OVERALL_PRIOR * UNIT} // sum(n) OVER (PARTITION BY measure) AS weight
  FROM (SELECT measure, g, sum(n) AS n FROM counts GROUP BY measure, g)),
parts AS (SELECT DISTINCT lang, source, measure FROM counts),
blended AS (
  SELECT lang, source, measure, g, sum(weight) AS weight FROM (
    SELECT lang, source, measure, g, n * {UNIT} AS weight FROM counts
    UNION ALL SELECT p.lang, p.source, p.measure, l.g, l.weight FROM parts p JOIN by_lang l ON p.lang IS NOT DISTINCT FROM l.lang AND p.measure = l.measure
    UNION ALL SELECT p.lang, p.source, p.measure, a.g, a.weight FROM parts p JOIN overall a ON p.measure = a.measure)
  WHERE weight > 0 GROUP BY lang, source, measure, g),
tails AS (
  SELECT lang, source, measure, {quantile(LOWER)}, {quantile(MIDDLE)}, {quantile(UPPER)} FROM (
    SELECT *, sum(weight) OVER (PARTITION BY lang, source, measure) AS total,
           sum(weight) OVER (PARTITION BY lang, source, measure ORDER BY g) AS upto
    FROM blended)
  GROUP BY lang, source, measure),
limits AS (SELECT lang, source, {limits} FROM tails GROUP BY lang, source)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({beyond}) AS kept
FROM measured m LEFT JOIN limits t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source
"""


RULES_SQL = _sql()
