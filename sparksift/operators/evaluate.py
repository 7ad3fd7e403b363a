"""Predicted against expected levels: confusion, per-class and summary measures."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import f1, safe_div

CLASSES = ("PUBLIC", "INTERNAL", "CONFIDENTIAL", "SECRET")


def matched(truth: DataFrame, predicted: DataFrame, key: str, keep_missing: bool = True) -> DataFrame:
    """truth(key, expected) with predicted(key, predicted). Without a prediction a row counts as PUBLIC, or is left out."""
    j = truth.join(predicted, key, "left" if keep_missing else "inner")
    return j.select(key, "expected", F.coalesce("predicted", F.lit("PUBLIC")).alias("predicted"))


def confusion(pairs: DataFrame) -> DataFrame:
    """Rows: expected; a column of counts per predicted class."""
    return pairs.groupBy("expected").pivot("predicted", list(CLASSES)).count().na.fill(0)


def class_metrics(pairs: DataFrame) -> DataFrame:
    """Per class: tp, fp, fn, support, precision, recall, f1; classes without rows included."""
    spark = pairs.sparkSession
    names = spark.createDataFrame([(c,) for c in CLASSES], "class string").coalesce(1)
    counts = pairs.groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n"))
    e, p, n = F.col("expected"), F.col("predicted"), F.col("n")
    g = names.join(F.broadcast(counts), (F.col("class") == e) | (F.col("class") == p), "left").groupBy("class")
    g = g.agg(*[F.coalesce(F.sum(F.when(c, n)), F.lit(0)).cast("long").alias(k) for k, c in (("tp", (e == F.col("class")) & (p == F.col("class"))), ("fp", (e != F.col("class")) & (p == F.col("class"))), ("fn", (e == F.col("class")) & (p != F.col("class"))))])
    g = g.withColumn("support", F.col("tp") + F.col("fn")).withColumn("precision", safe_div(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe_div(F.col("tp"), F.col("tp") + F.col("fn")))
    return g.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def binary_metrics(pairs: DataFrame) -> DataFrame:
    """Sensitive against PUBLIC: tp, fp, fn, precision, recall, f1, and the accuracy over all labels."""
    e, p = F.col("expected") != "PUBLIC", F.col("predicted") != "PUBLIC"
    g = pairs.agg(F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"), F.coalesce(F.avg((F.col("expected") == F.col("predicted")).cast("double")), F.lit(0.0)).alias("accuracy"))
    g = g.withColumn("precision", safe_div(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe_div(F.col("tp"), F.col("tp") + F.col("fn")))
    return g.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def macro_metrics(pairs: DataFrame) -> DataFrame:
    """Means over all classes, and of f1 over the classes that occur."""
    c = class_metrics(pairs)
    return c.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0)).alias("f1_supported"))


def _rank(name: str):
    c = F.col(name)
    out = F.when(c == CLASSES[0], 0)
    for i, k in enumerate(CLASSES[1:], 1):
        out = out.when(c == k, i)
    return out.otherwise(0)


def error_directions(pairs: DataFrame) -> DataFrame:
    """Wrong pairs of classes with their counts: under- or over-classified."""
    g = pairs.where("expected != predicted").groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("direction", F.when(_rank("predicted") < _rank("expected"), "under").otherwise("over"))


def mismatches(pairs: DataFrame, key: str) -> DataFrame:
    """Wrong rows by kind."""
    kind = F.when(F.col("predicted") == "PUBLIC", "false-negative").when(F.col("expected") == "PUBLIC", "false-positive").otherwise("label-mismatch")
    return pairs.where("expected != predicted").select(key, "expected", "predicted", kind.alias("kind"))


def report(pairs: DataFrame, key: str) -> Iterator[str]:
    """Lines of Markdown: the measures, and every wrong row, streamed from the executors a partition at a time."""
    b, m = binary_metrics(pairs).first(), macro_metrics(pairs).first()
    lines = ["# Evaluation", "", f"- accuracy: {b['accuracy']:.4f}", f"- binary precision, recall, f1: {b['precision']:.4f}, {b['recall']:.4f}, {b['f1']:.4f}", f"- macro precision, recall, f1: {m['precision']:.4f}, {m['recall']:.4f}, {m['f1']:.4f}", "", "| class | support | precision | recall | f1 |", "|-|-|-|-|-|"]
    order = {c: i for i, c in enumerate(CLASSES)}
    yield from lines
    yield from (f"| {r['class']} | {r['support']} | {r['precision']:.4f} | {r['recall']:.4f} | {r['f1']:.4f} |" for r in sorted(class_metrics(pairs).collect(), key=lambda r: order[r["class"]]))
    yield from ("", "| row | kind | expected | predicted |", "|-|-|-|-|")
    for r in mismatches(pairs, key).orderBy("kind", key).toLocalIterator():
        yield f"| {r[key]} | {r['kind']} | {r['expected']} | {r['predicted']} |"
