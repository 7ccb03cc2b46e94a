"""Quality rules: distribution divergence from language references (native).

Each text is described by two histograms: character classes, and the common
words of its language.  A language's reference is the sum of the histograms of
all its documents.  A document whose Jensen-Shannon distance (base 2, square
root, so within 0 and 1) from its reference exceeds the threshold is rejected.
Shares of few words scatter, so texts of 50 to 99 words are allowed a larger word
distance; below 50 the base rule rejects.  Under 200 characters the character
distance says little, and texts pass on it.

A word is common when it makes up at least ``COMMON_SHARE`` of its language's
words, hence a language has at most ``1 / COMMON_SHARE`` of them: the bound is
by construction, not by a cut.  Everything is a DataFrame expression; nothing
leaves the JVM and the texts themselves are never shuffled.

Cases: a null or empty text has no words and fails the base rule; a null
language is a language of its own; repeated rows are judged alike; a very long
text is judged whole, in memory in proportion to its words; words that tie for
a share are all common or all not, and a distance that equals its threshold
passes; an empty table gives an empty result; extra columns are carried or
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

WS = r"[\x20\x09-\x0D]"
COMMON_SHARE = 0.005
MAX_CHAR_DISTANCE = 0.33
MAX_WORD_DISTANCE = 0.28
#: The word distance allowed to texts of fewer than ``FEW_WORDS`` words, whose shares are coarser.
MAX_FEW_WORD_DISTANCE = 0.4
MIN_CHARS = 200
MIN_BASE_WORDS = MIN_WORDS = 50
FEW_WORDS = 100
REPEAT_PERCENT = 50

#: Disjoint character classes; what is in none of them is a lower-case ASCII letter or other ASCII.
CLASSES = {
    "space": WS,
    "upper": "[A-Z]",
    "digit": "[0-9]",
    "stop": "[.,;:!?'\"()-]",
    "symbol": "[#*$%&|<>]",
    "beyond": r"[^\x00-\x7F]",
}


def words(text: Column) -> Column:
    """Words of a text: maximal runs of anything but ASCII white space."""
    return F.array_remove(F.split(text, WS + "+", -1), "")


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", F.coalesce(F.col("row.text"), F.lit("")).alias("text"), F.coalesce(F.col("row.lang"), F.lit("\0")).alias("lang"))


def _classed(texts: DataFrame) -> DataFrame:
    """With ``n`` (characters) and ``chars`` (their number by class, what is in no class first) in place of the text."""
    carried = [c for c in texts.columns if c != "text"]
    # Lower-case letters and white space go first, in runs: what is left to count one by one is a small part of a text.
    d = texts.select(*carried, F.char_length("text").cast("long").alias("n"), F.regexp_replace("text", "[a-z]+", "").alias("rest"))
    d = d.select(*carried, "n", F.char_length("rest").cast("long").alias("n_rest"), F.regexp_replace("rest", WS + "+", "").alias("rest"))
    space = F.col("n_rest") - F.char_length("rest").cast("long")
    d = d.select(*carried, "n", *[(space if k == "space" else F.regexp_count("rest", F.lit(p)).cast("long")).alias(f"c_{k}") for k, p in CLASSES.items()])
    return d.select(*carried, "n", F.array(F.col("n") - sum(F.col(f"c_{k}") for k in CLASSES), *[F.col(f"c_{k}") for k in CLASSES]).alias("chars"))


def measure(docs: DataFrame) -> DataFrame:
    """``row`` (the input row), lang, the words ``w``, the base counts, and the class histogram ``chars``."""
    # Windows that run over the end hash fewer words, so they equal no whole one.
    windows = F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    d = _classed(
        _text(docs).select(
            "row", "lang", "text",
            words(F.col("text")).alias("w"),
            F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        )
    )
    d = d.select(
        "row", "lang", "w", "n", "chars",
        F.size("w").cast("long").alias("n_words"),
        (F.col("n") - F.col("chars")[1 + list(CLASSES).index("space")]).alias("word_chars"),
        F.col("chars")[1 + list(CLASSES).index("symbol")].alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("h"),
    )
    # Most texts repeat no window; in the others, equal windows are neighbours in the sorted array.
    numbered = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), numbered).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("h")
    same = lambda x, j: F.coalesce(F.get("s", j)["h"] == x["h"], F.lit(False))
    d = d.withColumn("again", F.filter("s", lambda x, i: same(x, i - 1) | same(x, i + 1))).drop("s")
    covered = F.array_distinct(F.flatten(F.transform("again", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return d.withColumn("n_repeat_words", F.size(covered).cast("long")).drop("again")


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, c): how often each language uses each word, over all documents."""
    return _text(docs).select("lang", F.explode(words(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("c"))


def word_references(docs: DataFrame) -> DataFrame:
    """One row per language: its ``common`` words and ``ref_words`` (shares, the rest last)."""
    counts = word_counts(docs)
    # A map-side sum per language costs nothing next to the counts and gives the denominator.
    counted = materialize(counts, "word-counts")
    totals = counted.groupBy("lang").agg(F.sum("c").alias("total"))
    common = (
        counted.join(totals, "lang").where(F.col("c") >= F.col("total") * COMMON_SHARE)
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct((F.col("c") / F.col("total")).alias("p"), "word")), asc=False).alias("x"))
    )
    rest = F.lit(1.0) - F.aggregate("x", F.lit(0.0), lambda a, x: a + x["p"])
    common = common.select("lang", F.transform("x", lambda x: x["word"]).alias("common"), F.concat(F.transform("x", lambda x: x["p"]), F.array(F.greatest(rest, F.lit(0.0)))).alias("ref_words"))
    return materialize(common, "word-references")


def char_references(classed: DataFrame) -> DataFrame:
    """(lang, chars) to one row per language: ``ref_chars``, the shares of the classes."""
    size = 1 + len(CLASSES)
    sums = classed.groupBy("lang").agg(*[F.sum(F.col("chars")[i]).alias(f"s{i}") for i in range(size)])
    n = F.greatest(sum(F.col(f"s{i}") for i in range(size)), F.lit(1))
    return sums.select("lang", F.array(*[F.col(f"s{i}") / n for i in range(size)]).alias("ref_chars"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares of one length."""
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    parts = F.zip_with(p, q, lambda a, b: term(a, (a + b) / 2) + term(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def _word_judged(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """``measure`` with ``word_distance`` in place of the words."""
    d = measure(docs).join(refs, "lang", "left")
    # Places in the list of common words, 0 for all others: histograms are then over short arrays of numbers.
    places = lambda w, common: F.filter(F.transform(w, lambda x: F.array_position(common, x)), lambda i: i > 0)
    d = d.withColumns({"common": F.coalesce("common", F.array().cast("array<string>")), "ref_words": F.coalesce("ref_words", F.array(F.lit(1.0)))})
    d = d.withColumn("at", places(F.col("w"), F.col("common"))).drop("w")
    d = d.withColumn("hist", F.transform("common", lambda c, i: (F.size("at") - F.size(F.array_remove("at", i.cast("long") + 1))).cast("double")))
    n = F.greatest(F.col("n_words"), F.lit(1))
    shares = F.concat(F.transform("hist", lambda x: x / n), F.array((F.col("n_words") - F.size("at")) / n))
    return d.withColumn("word_distance", F.when(F.col("n_words") >= MIN_WORDS, js_distance(shares, F.col("ref_words")))).drop("at", "hist", "common", "ref_words")


def _verdict(d: DataFrame, refs: DataFrame) -> DataFrame:
    """With char_distance, base_failed and kept; refs are those of ``char_references``."""
    d = d.join(refs, "lang", "left").withColumns({
        "base_failed": (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")),
        "char_distance": F.when(F.col("n") >= MIN_CHARS, js_distance(F.transform("chars", lambda x: x / F.col("n")), F.col("ref_chars"))),
    })
    most = F.when(F.col("n_words") < FEW_WORDS, MAX_FEW_WORD_DISTANCE).otherwise(MAX_WORD_DISTANCE)
    far = (F.coalesce("char_distance", F.lit(0.0)) > MAX_CHAR_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > most)
    return d.withColumn("kept", ~F.col("base_failed") & ~far)


REPORT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"]


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept and both distances.

    What a text yields is written before it is judged, so the classes are
    counted once, and filters on the report meet plain columns.
    """
    few = docs.select("doc_id", "text", "lang")
    found = _word_judged(few, word_references(few)).select("row.doc_id", "lang", "n", "chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "word_distance")
    found = materialize(found, "quality-counts")
    return _verdict(found, char_references(found)).select("doc_id", *REPORT)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with exactly the columns they came with."""
    few = docs.select("text", "lang")
    classes = materialize(char_references(_classed(_text(few).select("lang", "text"))), "char-references")
    d = _verdict(_word_judged(docs, word_references(few)), classes)
    # The row number ties the filter to its place: pushed down, it would repeat the
    # nested expressions behind "kept" once for each use, beyond any planner's patience.
    return d.withColumn("at", F.monotonically_increasing_id()).where(F.col("kept") & (F.col("at") >= 0)).select("row.*")


def _js_sql(p: str, q: str) -> str:
    half = f"(({p} + {q}) / 2)"
    return f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / {half}) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / {half}) ELSE 0 END)"


_COUNTED = ", ".join(f"length(regexp_replace(t, '[^{p[1:-1].replace(chr(39), chr(39) * 2)}]', '', 'g')) AS {k}" for k, p in CLASSES.items() if k != "beyond")
_NAMES = ["other", *CLASSES]

SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, chr(0)) AS lang, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
c AS (SELECT doc_id, lang, len(w) AS n, length(t) AS size, {_COUNTED}, length(regexp_replace(t, '[\x00-\x7F]', '', 'g')) AS beyond,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
e AS (SELECT *, size - space - upper - digit - stop - symbol - beyond AS other FROM c),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
u AS (SELECT lang, word, count(*) AS c FROM (SELECT lang, unnest(w) AS word FROM d) GROUP BY lang, word),
q AS (SELECT lang, word, c / total AS q FROM (SELECT *, sum(c) OVER (PARTITION BY lang) AS total FROM u) WHERE c >= total * {COMMON_SHARE}),
own AS (SELECT doc_id, word, count(*) AS c FROM (SELECT doc_id, unnest(w) AS word FROM d) GROUP BY doc_id, word),
h AS (SELECT c.doc_id, q.q, coalesce(own.c, 0) / greatest(c.n, 1) AS p FROM c JOIN q ON q.lang = c.lang LEFT JOIN own ON own.doc_id = c.doc_id AND own.word = q.word),
hr AS (SELECT doc_id, q, p FROM h UNION ALL SELECT c.doc_id, greatest(1 - coalesce(sum(q), 0), 0), (any_value(c.n) - coalesce(round(sum(p * greatest(c.n, 1))), 0)) / greatest(any_value(c.n), 1) FROM c LEFT JOIN h ON h.doc_id = c.doc_id GROUP BY c.doc_id),
wd AS (SELECT doc_id, sqrt(greatest(sum({_js_sql("p", "q")}) / 2, 0)) AS word_distance FROM hr GROUP BY doc_id),
l AS (SELECT lang, {", ".join(f"sum({k}) / greatest(sum(size), 1) AS {k}" for k in _NAMES)} FROM e GROUP BY lang),
cd AS (SELECT doc_id, sqrt(greatest(({" + ".join(_js_sql(f"(e.{k} / e.size)", f"l.{k}") for k in _NAMES)}) / 2, 0)) AS char_distance FROM e JOIN l ON l.lang = e.lang WHERE size >= {MIN_CHARS}),
v AS (SELECT e.doc_id, e.n, e.size - e.space AS word_chars, e.symbol, len(lines) - len(list_distinct(lines)) AS dup, coalesce(n_repeat, 0) AS rep, char_distance, CASE WHEN e.n >= {MIN_WORDS} THEN word_distance END AS word_distance
      FROM e LEFT JOIN r ON r.doc_id = e.doc_id LEFT JOIN wd ON wd.doc_id = e.doc_id LEFT JOIN cd ON cd.doc_id = e.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(symbol AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines, CAST(rep AS BIGINT) AS n_repeat_words,
       n < {MIN_BASE_WORDS} OR 100 * rep > {REPEAT_PERCENT} * n AS base_failed,
       NOT (n < {MIN_BASE_WORDS} OR 100 * rep > {REPEAT_PERCENT} * n) AND coalesce(char_distance, 0) <= {MAX_CHAR_DISTANCE} AND coalesce(word_distance, 0) <= CASE WHEN n < {FEW_WORDS} THEN {MAX_FEW_WORD_DISTANCE} ELSE {MAX_WORD_DISTANCE} END AS kept,
       round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance
FROM v
"""
