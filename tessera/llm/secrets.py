r"""Secret scan with multipart credential linking (native).

Base kinds, leftmost and non-overlapping for each: ``assign`` (a keyword, a
colon or equals sign, a value of 8 or more characters), ``access`` (access key
ids of 16 or more characters) and ``hex`` (32 or more hexadecimal digits).

Weak kinds are too common to report alone: ``ident`` (an assigned user, client
or key id), ``opaque`` (a run of 20 or more key characters, with at least four
digits and four letters) and ``endpoint`` (a URL).  The parts of a text form
intervals; a weak part is reported only when its complement lies within
``SCOPE`` code points of it:

* ident: near a secret (assign, hex or opaque);
* opaque: near an identifier (access or ident) or an endpoint, and apart from all base spans;
* endpoint: near an identifier and near a secret.

The interval join is a sweep: ordered by position, each part needs only the
nearest interval of each role on either side, which running maxima and minima
give in linear time, however many parts a text has.  Offsets come from the
lengths of matches and of the pieces between them.  The texts are scanned
where they lie; only lengths leave the scan.

Cases: a very long text is scanned whole, its parts as rows of their own; a null
or empty text has no spans; rows that repeat are scanned alike
and stay apart; ties of start go by kind as listed; an empty table gives an
empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize

SCOPE = 200
BASE = ("assign", "access", "hex")
#: kind: (pattern, group whose length counts, its least length)
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 16),
    "hex": (r"([0-9a-f]{32,})", 1, 32),
    "ident": (r"""(?i:access_?key_?id|client_?id|key_?id|user_?name|user_?id|user|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]+)""", 1, 3),
    "opaque": (r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{20,})", 1, 20),
    "endpoint": (r"""((?:https?|s3|ftp|jdbc:[a-z]+)://[^\x20\x09-\x0D"'<>]+)""", 1, 8),
}
#: A cheap test that says where the pattern cannot match.
GATES = {"ident": r"(?i)(?:id|name|user|login|account)[\"']?\x20*[:=]", "endpoint": "://"}
SECRETS, IDENTS = ("assign", "hex", "opaque"), ("access", "ident")


def _lengths(text: Column, kind: str) -> Column:
    """Of each match: the length of the piece before it, its own, and whether it is long enough."""
    pattern, group, least = KINDS[kind]
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    good = lambda x: F.length(x) >= least
    if kind == "opaque":
        good = lambda x: (F.length(x) >= least) & (F.length(F.regexp_replace(x, "[^0-9]", "")) >= 4) & (F.length(F.regexp_replace(x, "[^A-Za-z]", "")) >= 4)
    parts = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(whole)), whole, lambda a, b: F.struct(F.length(a).cast("long").alias("p"), F.length(b).cast("long").alias("m")))
    parts = F.zip_with(parts, F.regexp_extract_all(text, p, F.lit(group)), lambda a, g: F.struct(a["p"].alias("p"), a["m"].alias("m"), good(g).alias("ok")))
    gate = text.rlike(GATES.get(kind, pattern))
    return F.when(gate, parts).otherwise(F.array().cast("array<struct<p:bigint,m:bigint,ok:boolean>>"))


def _parts(scanned: DataFrame) -> DataFrame:
    """(rid, kind, rank, start, end) of every match that is long enough, in code points."""

    def tagged(rank: int, kind: str) -> Column:
        return F.transform(kind, lambda x, i: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), i.alias("i"), x.alias("x")))

    found = scanned.select("rid", F.explode(F.concat(*[tagged(i, k) for i, k in enumerate(KINDS)])).alias("r"))
    w = Window.partitionBy("rid", "r.kind").orderBy("r.i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("r.x.p") + F.col("r.x.m")).over(w)
    return found.withColumn("end", end).where("r.x.ok").select("rid", "r.kind", "r.rank", (F.col("end") - F.col("r.x.m")).alias("start"), "end")


def link(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The parts to report: all base ones, and weak ones with their complement in scope.

    parts: rid, kind, rank, start, end.
    """
    before = Window.partitionBy("rid").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("rid").orderBy("start", "rank").rowsBetween(1, Window.unboundedFollowing)

    def near(kinds: tuple[str, ...], gap: int) -> Column:
        """Whether a part of these kinds lies within ``gap``; a gap of -1 asks for overlap."""
        end = F.max(F.when(F.col("kind").isin(*kinds), F.col("end"))).over(before)
        start = F.min(F.when(F.col("kind").isin(*kinds), F.col("start"))).over(after)
        return F.coalesce(F.col("start") - end <= gap, F.lit(False)) | F.coalesce(start - F.col("end") <= gap, F.lit(False))

    # A part that overlaps a base span is that span seen again, so it is no complement either.
    clear = parts.withColumn("over", near(BASE, -1)).where(F.col("kind").isin(*BASE) | (F.col("kind") == "ident") | ~F.col("over")).drop("over")
    secret, ident, end = near(SECRETS, scope), near(IDENTS, scope), near(("endpoint",), scope)
    kind = F.col("kind")
    told = kind.isin(*BASE) | ((kind == "ident") & secret) | ((kind == "opaque") & (ident | end)) | ((kind == "endpoint") & ident & secret)
    return clear.withColumn("told", told).where("told").drop("told")


def secret_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    text = F.coalesce(F.col("text"), F.lit(""))
    scanned = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", *[_lengths(text, k).alias(k) for k in KINDS])
    scanned = materialize(scanned, "secret-parts")
    some = scanned.where(" or ".join(f"size({k}) > 0" for k in KINDS))
    parts = link(_parts(some)).select("rid", "kind", F.struct("start", "rank", F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("span")).alias("x"))
    base = F.col("kind").isin(*BASE)
    n = lambda k: F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}")
    joined = lambda c: F.array_join(F.transform(F.sort_array(c), lambda x: x["span"]), ",")
    found = parts.groupBy("rid").agg(*map(n, BASE), F.sum((~base).cast("long")).alias("n_linked"), joined(F.collect_list(F.when(base, F.col("x")))).alias("base"), joined(F.collect_list("x")).alias("spans"))
    out = scanned.select("rid", "doc_id").join(found, "rid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", *[zero(f"n_{k}") for k in BASE], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_linked"))


def _parts_sql(rank: int, kind: str) -> str:
    """Matches of a kind with their places, from the lengths of the pieces between them."""
    pattern, group, least = KINDS[kind]
    pattern = pattern.replace("(?<![A-Za-z0-9+/_-])", "").replace("'", "''")
    good = f"length(g) >= {least}" + (" AND length(regexp_replace(g, '[^0-9]', '', 'g')) >= 4 AND length(regexp_replace(g, '[^A-Za-z]', '', 'g')) >= 4" if kind == "opaque" else "")
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, e - m AS s, e FROM (SELECT doc_id, m, g, sum(p + m) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
      SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, length(unnest(string_split_regex(t, '{pattern}')[1:len(a)])) AS p, length(unnest(a)) AS m, unnest(regexp_extract_all(t, '{pattern}', {group})) AS g
      FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS a FROM d))) WHERE {good}"""


def _near_sql(kinds: tuple[str, ...], gap: int) -> str:
    those = "(" + ", ".join(f"'{k}'" for k in kinds) + ")"
    w = "PARTITION BY doc_id ORDER BY s, rank ROWS BETWEEN"
    return f"(coalesce(s - max(e) FILTER (WHERE kind IN {those}) OVER ({w} UNBOUNDED PRECEDING AND 1 PRECEDING) <= {gap}, false) OR coalesce(min(s) FILTER (WHERE kind IN {those}) OVER ({w} 1 FOLLOWING AND UNBOUNDED FOLLOWING) - e <= {gap}, false))"


_BASE = "('assign', 'access', 'hex')"
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS ({" UNION ALL ".join(_parts_sql(i, k) for i, k in enumerate(KINDS))}),
c AS (SELECT * FROM (SELECT *, {_near_sql(BASE, -1)} AS over FROM p) WHERE kind IN {_BASE} OR kind = 'ident' OR NOT over),
n AS (SELECT *, {_near_sql(SECRETS, SCOPE)} AS secret, {_near_sql(IDENTS, SCOPE)} AS ident, {_near_sql(("endpoint",), SCOPE)} AS place FROM c),
f AS (SELECT *, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS span FROM n WHERE kind IN {_BASE} OR (kind = 'ident' AND secret) OR (kind = 'opaque' AND (ident OR place)) OR (kind = 'endpoint' AND ident AND secret)),
x AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS a, count(*) FILTER (WHERE kind = 'access') AS b, count(*) FILTER (WHERE kind = 'hex') AS h, count(*) FILTER (WHERE kind NOT IN {_BASE}) AS l,
      string_agg(span, ',' ORDER BY s, rank) FILTER (WHERE kind IN {_BASE}) AS base, string_agg(span, ',' ORDER BY s, rank) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(h, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(coalesce(l, 0) AS BIGINT) AS n_linked
FROM d LEFT JOIN x ON x.doc_id = d.doc_id
"""
