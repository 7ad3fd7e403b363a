"""Keyword operators: occurrences, existence, counts, proximity, boosts and their explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules.catalog import DEFAULT
from ..rules.model import Catalog, ScanOptions
from .detect import distance, spread, view, zone
from .occurrences import entry_hits, rules_with_keyword


def keyword_table(spark, catalog: Catalog) -> DataFrame:
    """A row per keyword entry: rule_id, keyword, view (its bytes as characters), pri."""
    rows = [(r.id, w, view(w), p) for r in catalog.ordered() for w, p in r.keywords]
    return spark.createDataFrame(rows, "rule_id string, keyword string, view string, pri boolean").coalesce(1)


def keyword_hits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", catalog: Catalog = DEFAULT) -> DataFrame:
    """Every occurrence of every keyword entry, overlapping ones too: id, rule_id, keyword, pri, offset in bytes.

    Entries of a rule that repeat a keyword count repeatedly. Words are searched
    for in whole batches (see occurrences).
    """
    d = spread(docs.select(F.col(id_col), F.col(text_col).alias("__t"))).select(id_col, F.lower("__t").alias("__low"))
    d = d.select(id_col, entry_hits(F.col("__low"), catalog).alias("__hits"))
    return d.select(id_col, F.explode("__hits").alias("h")).select(id_col, "h.*")


def has_rule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", catalog: Catalog = DEFAULT) -> DataFrame:
    """Per document the rules of which it contains some keyword."""
    docs = spread(docs.select(F.col(id_col), F.col(text_col).alias("__t"))).select(id_col, rules_with_keyword(F.lower("__t"), catalog).alias("__rules"))
    return docs.select(id_col, F.explode("__rules").alias("rule_id"))


def primary_counts(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return hits.groupBy(id_col, "rule_id").agg(F.count_if("pri").alias("primary"), F.count(F.lit(1)).alias("hits"))


def near_match(found: DataFrame, hits: DataFrame, window: int, id_col: str = "doc_id") -> DataFrame:
    """Findings (id, rule_id, offset, length) with whether a primary and a secondary keyword lie within the window: a band join by rule, in blocks of bytes."""
    block = 4 * max(window, 64)
    f = found.select(id_col, "rule_id", "offset", "length", (F.col("offset") + F.col("length")).alias("end"))
    reach = F.explode(F.sequence(F.floor(F.greatest(F.col("offset") - window, F.lit(0)) / block), F.floor((F.col("end") + window) / block)))
    left = f.withColumn("__block", reach)
    right = hits.select(F.col(id_col), "rule_id", F.col("offset").alias("at"), "pri", F.floor(F.col("offset") / block).alias("__block"))
    j = left.join(right, [id_col, "rule_id", "__block"], "left")
    within = distance(F.col("at"), F.col("offset"), F.col("end")) <= window
    return j.groupBy(id_col, "rule_id", "offset", "length").agg(F.coalesce(F.max(within & F.col("pri")), F.lit(False)).alias("primary"), F.coalesce(F.max(within & ~F.col("pri")), F.lit(False)).alias("secondary"))


def explain_boost(found: DataFrame, hits: DataFrame, options: ScanOptions = ScanOptions(), id_col: str = "doc_id") -> DataFrame:
    """Per finding the keywords within the window, nearest first, with distance, zone and boost, and the capped sum."""
    f = found.select(id_col, "rule_id", "offset", "length", (F.col("offset") + F.col("length")).alias("end"))
    j = f.join(hits.withColumnRenamed("offset", "at"), [id_col, "rule_id"])
    d = distance(F.col("at"), F.col("offset"), F.col("end"))
    j = j.withColumn("dist", d).where(F.col("dist") <= options.window).withColumn("b", zone(F.col("dist"), F.col("pri"), options))
    number = F.when(F.col("dist") <= options.zones[0][0], 1).when(F.col("dist") <= options.zones[1][0], 2).otherwise(3)
    part: Column = F.concat("keyword", F.lit("@"), F.col("dist"), F.lit(" zone "), number, F.when(F.col("pri"), " primary +").otherwise(" secondary +"), F.col("b"))
    one = F.struct("dist", "keyword", "pri", part.alias("part"))
    g = j.groupBy(id_col, "rule_id", "offset", "length").agg(F.sort_array(F.collect_list(one)).alias("all"), F.sum("b").alias("sum"))
    return g.select(id_col, "rule_id", "offset", "length", F.array_join(F.transform("all", lambda x: x["part"]), ", ").alias("explanation"), F.least("sum", F.lit(options.most_boost)).cast("int").alias("boost_hundredths"))
