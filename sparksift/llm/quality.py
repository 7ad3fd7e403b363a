"""Quality rules as robust multivariate outliers, with DataFrame functions only.

Each text gives counts (words, their characters, symbols, repeated lines, words
in repeated 5-word windows). A base rule fails texts that are too short or repeat
too much. The others become vectors of four transformed statistics, and every
language and source gets a minimum-covariance-determinant estimate of their
location and scatter: from six starts (medians and quartile ranges; the rows on
one side of a statistic's median), concentration steps keep the CORE share of
rows nearest to the last estimate and take their mean and covariance, until the
determinant stops falling. The start of least determinant is kept, and its
estimate made anew from all rows that it finds near (WEIGHTED). Junk of less
than half a group's rows is thus outside the core. Rows beyond CUTOFF in squared
Mahalanobis distance are rejected. Groups of fewer than LEAST_ROWS rows use the estimate of their
language, then that of all rows.

Everything that is shuffled is a partial aggregate or a slim row; up to
BROADCAST_ROWS estimates are broadcast, of more only those of hot groups (fewer
than HEAVY_PARTS), and the others are joined.

Cases: null text has no words and fails the base rule; null languages and
sources are groups of their own; rows are judged one by one, repeated or not; an
empty table gives an empty result; other columns are ignored, whatever their
names. Repeated windows are compared by a 64-bit hash within one text.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WS, WS_CHARS, cut, hot_join, text_of

WINDOW = 5
DIMS = 4
CORE = 0.5
#: A start's steps end when the logarithm of the determinant falls by no more than this.
LEAST_FALL = 1e-3
#: The share of normal rows that the last, reweighted estimate is made of.
WEIGHTED = 0.975
LEAST_ROWS = 200
#: Of vectors that follow the estimated normal law, fewer than one in a million lie beyond it.
CUTOFF = 35.0
#: Statistics of few words are shrunk as if the text had so many more average words.
SHRINK = 20
#: Least standard deviation of each statistic, added to the scatter, so that a group without symbols or repeats does not reject the first.
FLOORS = (0.3, 0.5, 0.7, 0.8)
X = [f"x{i}" for i in range(DIMS)]
M = [f"m{i}" for i in range(DIMS)]
L = [f"l{i}{j}" for i in range(DIMS) for j in range(i + 1)]


def text_counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    base = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), text_of(text_col).alias("txt"))
    trimmed = F.btrim("txt", F.lit(WS_CHARS))
    lines = F.filter(F.split("txt", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = base.select(
        "id", "lang", "source",
        F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(trimmed, WS), lambda w: F.xxhash64(w))).alias("wh"),
        F.length(F.regexp_replace("txt", WS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("txt", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    wh = F.col("wh")
    grams = F.when(F.size(wh) < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(wh) - WINDOW), lambda i: F.xxhash64(*[F.get(wh, i + k) for k in range(WINDOW)])))
    b = a.select("id", "lang", "source", F.size(wh).cast("long").alias("n_words"), "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), grams.alias("g"))
    g = F.col("g")
    some = F.size(F.array_distinct(g)) < F.size(g)
    # Only texts that repeat a window sort them.
    c = b.withColumn("s", F.when(some, F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))))
    s = F.col("s")
    same = lambda j, k: F.get(s, j)["h"] == F.get(s, k)["h"]
    twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
    d = c.withColumn("p", F.when(s.isNotNull(), twice)).withColumn("p", F.when(s.isNotNull(), F.sort_array(F.transform("p", lambda j: F.get(s, j)["at"]))))
    p = F.col("p")
    covered = F.aggregate(F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda x, y: F.least(F.lit(WINDOW), y - x)), F.lit(WINDOW), lambda acc, x: acc + x)
    return d.select("id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(p.isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"))


def vector(mean_length: float) -> list[Column]:
    """The transformed statistics of a text."""
    n = F.col("n_words") + SHRINK
    rate = lambda c: F.log1p(100 * F.col(c) / n)
    return [((F.col("word_chars") + SHRINK * mean_length) / n).alias("x0"), rate("n_symbols").alias("x1"), rate("n_dup_lines").alias("x2"), rate("n_repeat_words").alias("x3")]


def _cdf(x: float, dof: int) -> float:
    """Of the chi-squared law; dof is even."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(dof // 2))


def quantile(share: float, dims: int) -> float:
    """The squared distance within which `share` of normal rows lie."""
    lo, hi = 0.0, 200.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _cdf(mid, dims) < share else (lo, mid)
    return lo


def consistency(core: float, dims: int) -> float:
    """What makes the covariance of the nearest `core` share of normal rows that of all; dims is even."""
    return core / _cdf(quantile(core, dims), dims + 2)


PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]
SHAPE = ["n", *M, *L]
MOMENTS = ", ".join(["first(n) AS n", *(f"avg(x{i}) AS m{i}" for i in range(DIMS)), *(f"covar_pop(x{i}, x{j}) AS c{i}{j}" for i, j in PAIRS)])


def _factor(scale: float) -> str:
    """SQL: the lower Cholesky factor of scale * c plus the floors. Its columns refer to those before."""
    out = []
    for i, j in PAIRS:
        rest = "".join([f"{scale!r}D * c{i}{j}", f" + {FLOORS[i] ** 2!r}D" * (i == j), *(f" - l{i}{k} * l{j}{k}" for k in range(j))])
        out.append(f"sqrt(greatest({rest}, 1e-9D)) AS l{i}{j}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    return ", ".join(out)


def _distance() -> str:
    """SQL: squared Mahalanobis distance d of x from the estimate, by forward substitution."""
    z = [f"(x{i} - m{i}" + "".join(f" - l{i}{k} * z{k}" for k in range(i)) + f") / l{i}{i} AS z{i}" for i in range(DIMS)]
    return ", ".join(z) + ", " + " + ".join(f"z{i} * z{i}" for i in range(DIMS)) + " AS d"


def _estimate(df: DataFrame, scale: float, where: str = "true") -> DataFrame:
    """gid, start, n, m0.., l00.., det (logarithm of the scatter's determinant) of the rows (gid, start, n, x0..) of each key."""
    det = " + ".join(f"2 * ln(l{i}{i})" for i in range(DIMS))
    return df.sparkSession.sql(f"SELECT gid, start, n, {', '.join(M)}, {_factor(scale)}, {det} AS det FROM (SELECT gid, start, {MOMENTS} FROM {{df}} WHERE {where} GROUP BY gid, start)", df=df)


def _near(rows: DataFrame, params: DataFrame, total: int, few: bool) -> DataFrame:
    """rows(gid, x0..) with each start's estimate of their group, and d. Few estimates are all broadcast, else those of hot groups."""
    both = rows.join(F.broadcast(params), "gid") if few else hot_join(rows, cut(params), ["gid"], "n", total)
    extra = [c for c in params.columns if c not in ("gid", "start", "n", "det", *M, *L)]
    return rows.sparkSession.sql(f"SELECT {', '.join(['gid', 'start', 'n', *X, *extra])}, {_distance()} FROM {{both}}", both=both)


def _starts(rows: DataFrame, groups: DataFrame, total: int, few: bool) -> DataFrame:
    """Per group and start: n, location and factor to begin with.

    Start 0 is made of medians and quartile ranges. The others are the rows up to
    the median of each statistic, and those from the first one's median on: junk
    that raises a statistic is mostly outside of one of these halves.
    """
    spark = rows.sparkSession
    q = cut(spark.sql(f"SELECT gid, n, {', '.join(f'q{i}[1] AS m{i}, pow((q{i}[2] - q{i}[0]) / 1.349D, 2) AS s{i}' for i in range(DIMS))} FROM (SELECT gid, {', '.join(f'percentile_approx(x{i}, array(0.25D, 0.5D, 0.75D), 1000) AS q{i}' for i in range(DIMS))} FROM {{rows}} GROUP BY gid) JOIN {{groups}} USING (gid)", rows=rows, groups=groups))
    cov = ", ".join(f"s{i} AS c{i}{j}" if i == j else f"0D AS c{i}{j}" for i, j in PAIRS)
    first = spark.sql(f"SELECT gid, 0 AS start, n, {', '.join(M)}, {_factor(1.0)}, 0D AS det FROM (SELECT *, {cov} FROM {{q}})", q=q)
    medians = q.select("gid", "n", *M)
    both = rows.join(F.broadcast(medians), "gid") if few else hot_join(rows, medians, ["gid"], "n", total)
    sides = ", ".join(f"CASE WHEN {c} THEN {k + 1} END" for k, c in enumerate([*(f"x{i} <= m{i}" for i in range(DIMS)), "x0 >= m0"]))
    halves = spark.sql(f"SELECT gid, n, {', '.join(X)}, explode(array_compact(array({sides}))) AS start FROM {{both}}", both=both)
    return cut(first.unionByName(_estimate(halves, 1.0)))


def _c_step(rows: DataFrame, params: DataFrame, total: int, few: bool) -> DataFrame:
    """The estimates by the CORE share of rows nearest to params."""
    spark = rows.sparkSession
    near = _near(rows, params, total, few)
    limit = spark.sql(f"SELECT gid AS g, start AS s, percentile_approx(d, {CORE}D, 10000) AS lim FROM {{near}} GROUP BY gid, start", near=near)
    if few:
        core = near.join(F.broadcast(limit), F.expr("gid = g AND start = s"))
    else:
        core = _near(rows, params.join(limit, F.expr("gid = g AND start = s")).drop("g", "s"), total, few)
    return _estimate(core, consistency(CORE, DIMS), "d <= lim")


def _least(rows: DataFrame, params: DataFrame, total: int, few: bool) -> DataFrame:
    """Per group, the estimate of least determinant among the starts, each stepped until its determinant stops falling."""
    spark, ended = rows.sparkSession, []
    falling = cut(_c_step(rows, params, total, few))
    while not falling.isEmpty():
        new = _c_step(rows, falling, total, few)
        both = cut(spark.sql(f"SELECT s.*, s.det < o.old - {LEAST_FALL} AS falls FROM {{new}} s JOIN (SELECT gid, start, det AS old FROM {{falling}}) o USING (gid, start)", new=new, falling=falling))
        ended.append(both.where("NOT falls").drop("falls"))
        falling = both.where("falls").drop("falls")
    done = reduce(DataFrame.unionByName, ended) if ended else falling
    return cut(spark.sql(f"SELECT gid, 0 AS start, x.* FROM (SELECT gid, min_by(struct({', '.join(SHAPE)}), struct(det, start)) AS x FROM {{done}} GROUP BY gid)", done=done))


def estimates(vectors: DataFrame) -> DataFrame:
    """vectors(lang, source, x0..) -> per (lang, source): group_rows, level of the estimate it uses, n, location m0.., factor of the scatter l00.. ."""
    spark = vectors.sparkSession
    flat = cut(vectors.selectExpr("cast(lang AS string) AS lang", "cast(source AS string) AS source", *X))
    sizes = cut(flat.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n2")))
    # Which level serves a group: its own rows, else its language's, else all. Levels that serve nobody are left out.
    by = cut(spark.sql(f"SELECT *, sum(n2) OVER (PARTITION BY lang) AS n1 FROM {{sizes}}", sizes=sizes).withColumn("level", F.expr(f"CASE WHEN n2 >= {LEAST_ROWS} THEN 2 WHEN n1 >= {LEAST_ROWS} THEN 1 ELSE 0 END")))
    total = by.agg(F.coalesce(F.sum("n2"), F.lit(0))).first()[0]
    keys = by.select("lang", "source", "n2", "level", F.expr("inline(array(struct(2 AS v, lang AS l, source AS s), struct(1 AS v, lang AS l, string(null) AS s), struct(0 AS v, string(null) AS l, string(null) AS s)))"))
    ids = cut(keys.groupBy("v", "l", "s").agg(F.sum("n2").alias("n"), F.max(F.col("level") == F.col("v")).alias("used")).where("used").select("v", "l", "s", "n").withColumn("gid", F.monotonically_increasing_id()))
    feeds = ids.select(F.col("v").alias("v_"), F.col("l").alias("l_"), F.col("s").alias("s_"), "gid")
    fed = cut(keys.join(feeds, F.expr("v = v_ AND l <=> l_ AND s <=> s_")).groupBy("lang", "source").agg(F.first("n2").alias("group_rows"), F.first("level").alias("level"), F.collect_list("gid").alias("gids"), F.max(F.expr("CASE WHEN v = level THEN gid END")).alias("own")))
    rows = cut(hot_join(flat, fed.select("lang", "source", "group_rows", "gids"), ["lang", "source"], "group_rows", total).select("gids", *X)).select(F.explode("gids").alias("gid"), *X)
    groups = ids.select("gid", "n")
    many, fed_rows = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    few = many * 6 <= BROADCAST_ROWS
    best = _least(rows, _starts(rows, groups, fed_rows, few), fed_rows, few)
    last = _estimate(_near(rows, best, fed_rows, few), consistency(WEIGHTED, DIMS), f"d <= {quantile(WEIGHTED, DIMS)!r}D").drop("start", "det")
    return cut(fed.select("lang", "source", "group_rows", "level", F.col("own").alias("gid")).join(last, "gid").drop("gid"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_words: int = 10, most_repeated: int = 20) -> DataFrame:
    """One row per document: id, the counts, base_failed, distance (null if the base rule failed), kept."""
    counts = cut(text_counts(docs, id_col, text_col, lang_col, source_col).withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))))
    good = counts.where(~F.col("base_failed"))
    total, chars, words = good.agg(F.count(F.lit(1)), F.sum("word_chars"), F.sum("n_words")).first()
    mean_length = chars / words if words else 0.0
    resolved = estimates(good.select("lang", "source", *vector(mean_length)))
    judged = hot_join(good, resolved.withColumnsRenamed({"n": "__n"}), ["lang", "source"], "group_rows", total, "left").select(*counts.columns, *vector(mean_length), *M, *L)
    judged = docs.sparkSession.sql(f"SELECT {', '.join(counts.columns)}, {_distance()} FROM {{judged}}", judged=judged).select(*counts.columns, F.col("d").alias("distance")).withColumn("kept", F.coalesce(F.col("distance") <= CUTOFF, F.lit(True)))
    failed = counts.where("base_failed").withColumn("distance", F.lit(None).cast("double")).withColumn("kept", F.lit(False))
    return judged.unionByName(failed).withColumnsRenamed({"id": id_col, "lang": lang_col, "source": source_col})
