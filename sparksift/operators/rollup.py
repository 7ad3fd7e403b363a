"""From findings to levels: per chunk, then per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.levels import CONFIDENTIAL, label_of, level_code
from ..functions.scalars import entropy, rule_prefix
from ..rules.catalog import DEFAULT
from ..rules.model import Catalog, Compound, ScanOptions


def tags_of() -> Column:
    """category, rule id, its prefix, and category_prefix of a finding."""
    prefix = rule_prefix(F.col("rule_id"))
    return F.array(F.col("category"), F.col("rule_id"), prefix, F.concat_ws("_", "category", prefix))


def tag_levels(found: DataFrame, keys: list[str]) -> DataFrame:
    """Highest level of each tag."""
    return found.select(*keys, F.explode(tags_of()).alias("tag"), "level").groupBy(*keys, "tag").agg(F.max("level").alias("level"))


def _is_tag(name: str, least: int):
    return lambda t: (t["tag"] == name) & (t["level"] >= least)


def _holds(c: Compound, tags: Column) -> Column:
    """Relational division: each condition is a tag, at or above the least level."""
    least = level_code(c.least) if c.least else 0
    out = F.lit(True)
    for name in c.conditions:
        out = out & F.exists(tags, _is_tag(name, least))
    return out


def chunk_levels(found: DataFrame, id_col: str = "doc_id", catalog: Catalog = DEFAULT, options: ScanOptions = ScanOptions()) -> DataFrame:
    """One row per chunk with findings: hit_level, entropy (where it can matter), level, violations."""
    return _chunk_levels(found, id_col, catalog, options).drop("n_chunks", "items")


def _chunk_levels(found: DataFrame, id_col: str, catalog: Catalog, options: ScanOptions) -> DataFrame:
    keys = [id_col, "chunk_idx"]
    item = F.struct("seq", "rule_id", "offset", "length", F.round("confidence", 4).alias("confidence"))
    each = found.select(*keys, "n_chunks", item.alias("item"), "level", "chunk_bytes", "__chunk", F.transform(tags_of(), lambda t: F.struct(t.alias("tag"), F.col("level").alias("level"))).alias("tags"))
    # a chunk's rows carry the same bytes: their entropy is computed once, after the grouping
    g = each.groupBy(*keys).agg(F.first("n_chunks").alias("n_chunks"), F.sort_array(F.collect_list("item")).alias("items"), F.max("level").alias("hit_level"), F.first("chunk_bytes").alias("chunk_bytes"), F.first("__chunk", ignorenulls=True).alias("__chunk"), F.array_distinct(F.flatten(F.collect_set("tags"))).alias("tags"))
    g = g.withColumn("entropy", F.when((F.col("hit_level") < 3) & F.col("__chunk").isNotNull(), entropy(F.col("__chunk"))))
    bumped = F.when((F.col("entropy") >= options.entropy_threshold) & (F.lit(options.entropy_threshold) > 0), F.greatest("hit_level", F.lit(CONFIDENTIAL))).otherwise(F.col("hit_level"))
    g = g.withColumn("bumped", bumped)
    level, found_v = F.col("bumped"), []
    for c in catalog.compounds:
        holds = _holds(c, F.col("tags"))
        level = F.greatest(level, F.when(holds, level_code(c.result)).otherwise(0))
        if c.violation:
            found_v.append(F.when(holds, F.struct(F.lit(c.name).alias("name"), F.lit(level_code(c.result)).alias("result_level"), F.lit(c.violation).alias("violation_type"), F.lit(c.alert or "").alias("alert_priority"))))
    violations = F.array_compact(F.array(*found_v)) if found_v else F.array().cast("array<struct<name:string,result_level:int,violation_type:string,alert_priority:string>>")
    return g.select(*keys, "n_chunks", "items", "hit_level", "entropy", "bumped", level.cast("int").alias("level"), violations.alias("violations"), F.array_sort(F.array_distinct(F.transform("tags", lambda t: t["tag"]))).alias("tags"))


def distinct_findings(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """In documents of several chunks, one finding per rule, offset and length: that of the first chunk."""
    many = found.where("n_chunks > 1")
    keys = [id_col, "rule_id", "offset", "length"]
    first = many.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in found.columns if c not in keys]), F.struct("chunk_idx", "seq")).alias("x"))
    return found.where("n_chunks = 1").unionByName(first.select(*keys, "x.*").select(*found.columns))


def _same(x: Column):
    return lambda y: (x["rule_id"] == y["rule_id"]) & (x["offset"] == y["offset"]) & (x["length"] == y["length"])


def document_levels(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", catalog: Catalog = DEFAULT, options: ScanOptions = ScanOptions()) -> DataFrame:
    """One row per document: level_code, level, match_count, matches, violations.

    One pass over the findings. Repeated findings of documents of several chunks
    (see distinct_findings) are dropped within the document's own lists: they can
    only repeat one of the same chunk, or, in the overlap, one of the chunk before.
    """
    part = F.struct("chunk_idx", "n_chunks", "items")
    g = _chunk_levels(found, id_col, catalog, options).groupBy(id_col).agg(F.max("level").alias("level_code"), F.array_distinct(F.flatten(F.collect_list("violations"))).alias("violations"), F.sort_array(F.collect_list(part)).alias("parts"))
    parts = F.col("parts")

    def kept(c: Column, k: Column) -> Column:
        edge = c["chunk_idx"].cast("long") * options.chunk_bytes
        before = lambda x: F.exists(F.get(parts, k - 1)["items"], _same(x))
        fresh = F.filter(c["items"], lambda x, i: ~F.exists(F.slice(c["items"], 1, i), _same(x)) & ((k == 0) | (x["offset"] >= edge) | ~F.coalesce(before(x), F.lit(False))))
        return F.when(c["n_chunks"] == 1, c["items"]).otherwise(fresh)

    matches = F.transform(F.flatten(F.transform(parts, kept)), lambda x: F.struct(x["rule_id"].alias("rule_id"), x["offset"].alias("offset"), x["length"].alias("length"), x["confidence"].alias("confidence")))
    g = g.select(id_col, "level_code", "violations", matches.alias("matches"))
    out = docs.select(id_col).join(g, id_col, "left")
    code = F.coalesce("level_code", F.lit(0)).cast("int")
    return out.select(id_col, code.alias("level_code"), label_of(code).alias("level"), F.coalesce(F.size("matches"), F.lit(0)).cast("long").alias("match_count"), "matches", "violations")


def level_distribution(levels: DataFrame, least: int = 1) -> DataFrame:
    """Documents per level, from `least` up, and how many were scanned."""
    g = levels.groupBy("level_code", "level").agg(F.count(F.lit(1)).alias("n"))  # four rows at most
    return g.withColumn("scanned", F.sum("n").over(Window.partitionBy(F.lit(0)))).where(F.col("level_code") >= least).select("level", "n", "scanned")


def top_findings(found: DataFrame, id_col: str = "doc_id", k: int = 3) -> DataFrame:
    """The first k findings of each document in emission order, and how many more there are."""
    one = F.struct("chunk_idx", "seq", "rule_id", "offset", "length", "preview", "level")
    g = found.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(one)).alias("all"))
    return g.select(id_col, F.greatest(F.col("n") - k, F.lit(0)).alias("more"), F.posexplode(F.slice("all", 1, k)).alias("rank", "x")).select(id_col, (F.col("rank") + 1).alias("rank"), "more", "x.rule_id", "x.offset", "x.length", "x.preview", "x.level")
