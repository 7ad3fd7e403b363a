"""Language identification by Bayesian evidence fusion.

Three kinds of evidence meet for each text:
- its likelihood under byte-trigram models of the languages, and of a class
  "und" of no language, in which all trigrams are alike;
- the language its markup declares, by how often each language's texts declare
  it (a table estimated over all rows);
- where it is from: the share of each language at its host, smoothed by that of
  the host's domain, that by the address suffix, and that by all rows. These
  shares are sums of text posteriors in grouped aggregates over all rows; a
  row's own share is left out of its host's.

Only fitting uses a sample: of each labelled language at most `fit_rows` rows,
those of the least hash of id and text. Every labelled language has a class. A
text is rejected when its best class is "und" or has less than `least` of the
posterior.

Cases: null or empty text, or one of fewer than three bytes or without letters, is "und" and
rejected; null hosts, suffixes and declarations are values like others; without
labelled rows everything is "und"; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_bytes, ascii_lower, cut, drop_rows, hot_join, spans, text_of, tidy

BUCKETS = 1 << 16
BLOCK_BYTES = 1 << 20
UND = "und"
#: Trigrams of a text depend on each other; their likelihood counts with this power.
TEMPER = 0.3
#: A level's shares weigh as much as so many rows at the level below.
STRENGTH = 20.0
UND_PRIOR = 0.001
#: A-Z count as lower case; controls, digits, signs and spaces all count as a space.
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[[i for i in range(128) if not chr(i).isalpha()]] = 32


def _buckets(d: np.ndarray) -> np.ndarray:
    x = _LOWER[d]
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(16)


#: The bucket of three spaces, which is no evidence.
BLANK = int(_buckets(np.frombuffer(b"   ", np.uint8))[0])


def _crossing(o: np.ndarray, n: int) -> np.ndarray:
    """Positions whose trigram runs over the end of its text."""
    at = np.concatenate([o[1:] - 1, o[1:] - 2])
    return at[(at >= 0) & (at < n)]


def fit(docs: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int) -> tuple[list[str], np.ndarray]:
    """Languages and the log likelihood (BUCKETS, languages + 1) of each trigram; the last column is that of "und"."""
    labelled = docs.where(F.col(label_col).isNotNull()).select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("r"), F.col(label_col).cast("string").alias("lang"), text_of(text_col).alias("txt"))
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    # A share of each language's rows, by hash, that holds about twice as many as needed; of those, exactly so many.
    share = F.least(F.lit(1.0), 2.0 * (fit_rows + 50) / F.col("rows"))
    some = labelled.join(F.broadcast(cut(sizes)), "lang").where(F.shiftrightunsigned("r", 11) < share * float(1 << 53))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("r"))
    sample = some.withColumn("rank", rank).where(F.col("rank") <= fit_rows).select("lang", "txt")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, c in sums.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "bucket", "n"])
            sums.clear()

        for b in batches:
            d, o = arrow_bytes(b.column("txt"))
            for lang, s, e in zip(b.column("lang").to_pylist(), o[:-1].tolist(), o[1:].tolist()):
                if e - s >= 3:
                    if lang not in sums and len(sums) >= 32:
                        yield from out()
                    sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    sums[lang] += np.bincount(_buckets(d[s:e]), minlength=BUCKETS)
                    sums[lang][BLANK] = 0
        yield from out()

    got = sample.mapInArrow(tidy(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    table = np.full((BUCKETS, len(langs)), 0.1)
    for i, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        table[own["bucket"].to_numpy(), i] += own["n"].to_numpy()
    logs = np.column_stack([np.log(table / table.sum(axis=0)), np.full(BUCKETS, -np.log(BUCKETS))])
    logs[BLANK] = 0
    return langs, logs.astype(np.float32)


def text_likelihoods(rows: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """rows(.., txt) -> (.., n trigrams, ll array: the log likelihood of each language, then of "und")."""
    keep = [c for c in rows.columns if c != "txt"]
    k = len(langs)
    flat = np.log(BUCKETS)
    block = max(1 << 12, BLOCK_BYTES * 8 // (k + 8))  # of many languages, fewer bytes at a time

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = arrow_bytes(b.column("txt"))
            sums = np.zeros((len(b), k + 1))
            counts = np.maximum(np.diff(offsets) - 2, 0)
            for i, j in spans(offsets, block):
                for s in range(int(offsets[i]), int(offsets[j]), block if j == i + 1 else 1 << 62):
                    e = min(int(offsets[j]), s + block + 2) if j == i + 1 else int(offsets[j])
                    d = data[s:e]
                    if len(d) < 3:
                        continue
                    g = np.zeros((len(d), k + 1), table.dtype)  # no trigram begins at the last two bytes
                    np.take(table, _buckets(d), axis=0, out=g[:-2])
                    if j > i + 1:
                        o = offsets[i : j + 1] - s
                        cross = _crossing(o, len(g) - 2)
                        g[cross] = 0
                        at = np.minimum(o[:-1], len(g) - 1)
                        add = np.add.reduceat(g, at, axis=0, dtype=np.float64)
                        add[counts[i:j] == 0] = 0
                        sums[i:j] += add
                    else:
                        sums[i] += g.sum(axis=0, dtype=np.float64)
            counts = np.rint(-sums[:, k] / flat).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * (k + 1)), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(counts), lists], names=[*keep, "n", "ll"])

    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("n", T.LongType()), T.StructField("ll", T.ArrayType(T.DoubleType()))])
    return rows.select(*keep, "txt").mapInArrow(tidy(run), schema)


def _softmax(rows: DataFrame, logs: Column, name: str) -> DataFrame:
    """rows with the array `name` of the shares that the array `logs` of logarithms stands for."""
    rest = rows.columns
    rows = rows.select(*rest, logs.alias("__logs")).select(*rest, "__logs", F.array_max("__logs").alias("__top"))
    rows = rows.select(*rest, F.transform("__logs", lambda x: F.exp(x - F.col("__top"))).alias("__parts"))
    rows = rows.select(*rest, "__parts", F.aggregate("__parts", F.lit(0.0), lambda a, x: a + x).alias("__sum"))
    return rows.select(*rest, F.transform("__parts", lambda x: x / F.col("__sum")).alias(name))


def _numbers(xs) -> Column:
    return F.expr(f"array({', '.join(f'{float(x)!r}D' for x in xs)})")


def _shares(sums: Column, n: Column, above: Column) -> Column:
    """A level's shares, smoothed by those above."""
    return F.zip_with(sums, above, lambda s, p: (s + STRENGTH * p) / (n + STRENGTH))


def identify(rows: DataFrame, langs: list[str], table: np.ndarray, least: float = 0.3) -> DataFrame:
    """rows(id, th, host, domain, suffix, declared, txt) -> id, th, host, lang, posterior, kept, text_lang."""
    spark, k = rows.sparkSession, len(langs) + 1
    names = F.array(*[F.lit(x) for x in [*langs, UND]])
    priors = [(1 - UND_PRIOR) / max(1, k - 1)] * (k - 1) + [UND_PRIOR]
    each = text_likelihoods(rows, langs, table)
    each = _softmax(each.select("id", "th", "host", "domain", "suffix", "declared", "n", "ll"), F.zip_with("ll", _numbers(np.log(priors)), lambda x, p: x * TEMPER + p), "q")
    each = cut(each)
    total = each.count()
    S = [f"s{i}" for i in range(k)]
    sums = [F.sum(F.col("q")[i]).alias(s) for i, s in enumerate(S)]
    again = [F.sum(s).alias(s) for s in S]
    both = F.array(*S)

    # The declaration: which of the languages, another, or none.
    said = F.when(F.col("declared").isin(langs), F.col("declared")).when(F.col("declared").isNotNull(), F.lit("other")) if langs else F.lit(None).cast("string")
    found = each.groupBy(said.alias("d")).agg(*sums).collect()
    every = np.array([[r[c] for c in S] for r in found]).sum(axis=0) if found else np.ones(k)
    world = (every + 1e-3) / (every + 1e-3).sum()
    marks = spark.createDataFrame([(r["d"], [float(np.log((r[c] + 1) / (every[i] + len(found)))) for i, c in enumerate(S)]) for r in found], "d string, mark array<double>")

    hosts = cut(each.groupBy("suffix", "domain", "host").agg(F.count(F.lit(1)).alias("rows"), *sums))
    domains = cut(hosts.groupBy("suffix", "domain").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("hosts"), *again))
    suffixes = domains.groupBy("suffix").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("domains"), *again)
    suffixes = cut(suffixes.select("suffix", "domains", _shares(both, F.col("rows"), _numbers(world)).alias("up")))
    n_hosts, n_domains = hosts.count(), domains.count()
    domains = hot_join(domains, suffixes, ["suffix"], "domains", n_domains)
    domains = cut(domains.select("suffix", "domain", "hosts", _shares(both, F.col("rows"), F.col("up")).alias("up")))
    hosts = cut(hot_join(hosts, domains, ["suffix", "domain"], "hosts", n_hosts).select("suffix", "domain", "host", F.col("rows").alias("host_rows"), both.alias("sums"), "up"))

    j = hot_join(each, hosts, ["suffix", "domain", "host"], "host_rows", total).withColumn("said", said)
    j = j.join(F.broadcast(marks), F.col("said").eqNullSafe(F.col("d")))
    prior = _shares(F.zip_with("sums", "q", lambda s, x: s - x), F.col("host_rows") - 1, F.col("up"))
    logs = F.zip_with(F.zip_with("ll", prior, lambda x, p: x * TEMPER + F.log(F.greatest(p, F.lit(1e-6)))), "mark", lambda x, m: x + m)
    j = _softmax(j.select("id", "th", "host", "n", "q", logs.alias("logs")), F.col("logs"), "post")
    best = lambda c: F.when(F.col("n") == 0, F.lit(UND)).otherwise(F.element_at(names, F.array_position(F.col(c), F.array_max(c)).cast("int")))
    out = j.select("id", "th", "host", best("post").alias("lang"), F.round(F.array_max("post"), 6).alias("posterior"), best("q").alias("text_lang"))
    return out.withColumn("kept", (F.col("lang") != UND) & (F.col("posterior") >= least))


def documents_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Documents have no markup and no address; their source stands for the host."""
    none = F.lit(None).cast("string")
    txt = text_of(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(txt).alias("th"), F.col(source_col).cast("string").alias("host"), none.alias("domain"), none.alias("suffix"), none.alias("declared"), txt.alias("txt"))


def pages_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Visible text, declared language, and the host with its domain and suffix, of raw web pages."""
    html = text_of(html_col)
    declared = F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)), F.lit(""))
    txt = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#A-Za-z0-9]+;", " ")
    txt = F.regexp_replace(txt, r"[\x20\x09-\x0D]+", " ")
    host = F.nullif(ascii_lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"://([^/?#:]*)", 1)), F.lit(""))
    base = pages.select(F.col(id_col).alias("id"), txt.alias("txt"), host.alias("host"), declared.alias("declared"))
    parts = F.split("host", r"\.")
    return base.select("id", F.xxhash64("txt").alias("th"), "host", F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".").alias("domain"), F.element_at(parts, -1).alias("suffix"), "declared", "txt")


def identify_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", source_col: str = "source", fit_rows: int = 1000, least: float = 0.3) -> DataFrame:
    """One row per document: id, th, source, lang, posterior, text_lang, kept."""
    langs, table = fit(docs, id_col, text_col, label_col, fit_rows)
    return identify(documents_rows(docs, id_col, text_col, source_col), langs, table, least).withColumnsRenamed({"id": id_col, "host": source_col})


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs whose language is identified, with all their columns."""
    found = identify_documents(docs, id_col, text_col, **options)
    return drop_rows(docs, found.select(F.col(id_col).alias("id"), F.col("th").alias("key"), "kept"), id_col, F.xxhash64(F.coalesce(docs[text_col], F.lit(""))))
