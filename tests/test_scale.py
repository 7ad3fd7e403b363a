"""Work per text that grows with the text and no faster, and scans that are spread over the cores."""

import time

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from sparksift import queries as core
from sparksift.functions.scalars import entropy
from sparksift.operators import html, occurrences
from sparksift.operators.detect import findings
from sparksift.operators.keywords import explain_boost, has_rule, keyword_hits, near_match
from sparksift.rules.catalog import DEFAULT
from sparksift.rules.model import Catalog, Pattern, Rule

MANY = Catalog((Rule("test_001", "t", "pii", "INTERNAL", 1.0, 1, (Pattern(r"\b\d{6}\b", 0.9),), primary=("cvc",), secondary=("vc c", "cvc")),))


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def within(seconds, run):
    began = time.time()
    out = run()
    assert time.time() - began < seconds
    return out


def test_many_keywords_in_a_text(spark):
    d = docs(spark, "é" + "cvc " * 12000)
    hits = within(60, lambda: keyword_hits(d, catalog=MANY).collect())
    assert sorted((r["keyword"], r["pri"], r["offset"]) for r in hits) == sorted([("cvc", p, 2 + 4 * i) for i in range(12000) for p in (True, False)] + [("vc c", False, 3 + 4 * i) for i in range(11999)])


def test_overlapping_words_end_with_their_text(spark):
    c = Catalog((Rule("test_001", "t", "pii", "INTERNAL", 1.0, 1, (), primary=("aa",)),))
    rows = keyword_hits(docs(spark, "aaa", None, "a", "a", "", "AA"), catalog=c).collect()
    assert sorted((r["doc_id"], r["offset"]) for r in rows) == [(0, 0), (0, 1), (5, 0)]
    assert [r["doc_id"] for r in has_rule(docs(spark, "aaa", None, "a", "A"), catalog=c).collect()] == [0]


def test_many_matches_in_a_chunk(spark):
    d = docs(spark, "ab1234" + " é 123456" * 5000 + "x", "\x01 123456 \x02")
    found = within(60, lambda: findings(d, catalog=MANY).select("doc_id", "offset", "length", "value").collect())
    text = ("ab1234" + " é 123456" * 5000 + "x").encode()
    assert {r["value"] for r in found} == {"123456"} and all(text[r["offset"] :].startswith(b"123456") for r in found if not r["doc_id"])
    assert len(found) >= 5000 and [r["offset"] for r in found if r["doc_id"]] == [2]


def test_seeded_texts_are_spread(spark):
    """A union with a table of many partitions leaves the few of the other one as they are."""
    least = 2 * spark.sparkContext.defaultParallelism
    assert core._seeded(spark, SMALL).rdd.getNumPartitions() >= least


@pytest.mark.parametrize("run", [lambda d: near_match(findings(d, catalog=MANY), keyword_hits(d, catalog=MANY), 50), lambda d: explain_boost(findings(d, catalog=MANY), keyword_hits(d, catalog=MANY))])
def test_keywords_of_many_texts(spark, run):
    d = docs(spark, *["cvc 123456 " + "cvc " * 200] * 3000)
    assert within(90, lambda: run(d).count()) == 3000


def test_one_pass_for_several_expressions():
    texts = pa.array(["ab", None, "b", "zé", ""])
    got = {k: r.tolist() for k, r in occurrences.matching(texts, ["a", "b|é", "q"])}
    assert got == {0: [0], 1: [0, 2, 3], 2: []}
    assert list(occurrences.spans(pa.array(["1a22", "\x01\x02é3"]), r"\d+")) == [[(0, 1), (2, 4)], [(4, 5)]]


def test_entropy_by_counts(spark):
    texts = ["aabb", "", None, "é", "".join(map(chr, range(128))) * 3000]
    d = docs(spark, *texts)
    plan = d.select(entropy(F.encode("text", "UTF-8")).alias("e"))
    assert [r["e"] for r in plan.collect()] == [pytest.approx(x) if x is not None else None for x in (1.0, 0.0, None, 1.0, 7.0)]
    assert "ArrowEvalPython" in plan._jdf.queryExecution().executedPlan().toString()


def test_byte_entropy_has_no_row_for_no_bytes(spark, tmp_path, duck):
    docs(spark, "abc", "", None).write.parquet(f"{tmp_path}/documents.parquet")
    duck.sql(f"CREATE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {r["doc_id"] for r in core.byte_entropy(spark, str(tmp_path)).collect()} == {r[0] for r in duck.sql(core.ORACLES["byte_entropy"]).fetchall()} == {0}


def test_pages_are_read_in_pieces():
    """At no time are more than a piece of the pages Python strings."""
    import tracemalloc

    page = "<p>" + "word " * 4000 + "</p>"
    pages = pa.array([page] * 3000 + [None])
    tracemalloc.start()
    out = html.html_text.func(pages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * html.PAGES * len(page) < len(page) * 3000 / 2
    assert len(out) == 3001 and out[3000].as_py() is None and out[0].as_py() == html.visible_text(page)


def test_boosts_by_entries_of_a_word():
    from sparksift.rules.model import ScanOptions

    assert occurrences._points([("a", True), ("a", False), ("b", False)], ScanOptions()) == [(b"a", [(20, 22), (50, 15), (200, 7)]), (b"b", [(20, 7), (50, 5), (200, 2)])]
    assert np.array_equal(occurrences.rows_with(pa.array(["x", None]), occurrences.any_of(["xy", "x"])), [0]) and DEFAULT.patterns()


def test_ngram_sends_batches_of_many_rows():
    from sparksift.llm.common import merged

    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([b"x" * 100])], names=["i", "b"]) for i in range(2500)]
    out = list(merged(iter)(batches))
    assert [b.num_rows for b in out] == [1000, 1000, 500]
    assert [x for b in out for x in b.column("i").to_pylist()] == list(range(2500))
    assert [b.num_rows for b in merged(iter, size=250)(batches[:5])] == [3, 2]


def test_ngram_pieces_follow_the_keys_that_are_left(spark):
    from sparksift.llm.ngram import pieces

    cores = 2 * spark.sparkContext.defaultParallelism
    assert pieces(spark, 10**9, 10**6, 10**9) == 1000  # never more than the corpus makes
    assert pieces(spark, 10**8, 10**6, 10**9) == 100
    assert pieces(spark, 0, 10**6, 10**9) == cores
    assert pieces(spark, 0, 10**6, 10) == 2
