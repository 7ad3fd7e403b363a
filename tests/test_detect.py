"""Boundaries of scoring, chunking and roll-up, by hand."""

import re

import pytest
from pyspark.sql import functions as F

from sparksift.functions.dialect import to_java
from sparksift.operators.chunk import bounds, chunk
from sparksift.operators.detect import findings, public
from sparksift.operators.rollup import chunk_levels, distinct_findings, document_levels
from sparksift.rules.catalog import DEFAULT
from sparksift.rules.model import Catalog, Compound, Pattern, Rule, ScanOptions


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def rule(**k):
    base = dict(id="test_001", name="t", category="pii", level="INTERNAL", weight=1.0, priority=1, patterns=(Pattern(r"\b\d{6}\b", 0.5),), primary=("cvc",))
    return Catalog((Rule(**(base | k)),))


@pytest.mark.parametrize("gap,boost", [(17, 0.15), (18, 0.10), (47, 0.10), (48, 0.05), (197, 0.05), (198, 0.0)])
def test_zones_before(spark, gap, boost):
    # the distance counts from the keyword's first byte
    got = findings(docs(spark, "cvc" + " " * gap + "123456"), catalog=rule(), raw=True).first()
    assert got["boost"] == pytest.approx(boost) and got["offset"] == 3 + gap


@pytest.mark.parametrize("gap,boost", [(19, 0.15), (20, 0.10), (199, 0.05), (200, 0.0)])
def test_zones_after(spark, gap, boost):
    got = findings(docs(spark, "123456" + " " * gap + "cvc"), catalog=rule(), raw=True).first()
    assert got["boost"] == pytest.approx(boost)


def test_overlapping_keywords_and_cap(spark):
    one = findings(docs(spark, "cvcvc 123456"), catalog=rule(), raw=True).first()
    assert one["boost"] == pytest.approx(0.30)
    assert findings(docs(spark, "cvc cvc cvc cvc 123456"), catalog=rule(), raw=True).first()["boost"] == pytest.approx(0.30)


def test_threshold_is_inclusive(spark):
    c = rule(patterns=(Pattern(r"\b\d{6}\b", 0.45),))
    assert findings(docs(spark, "cvc 123456"), catalog=c).count() == 1  # 0.45 + 0.15
    assert findings(docs(spark, "cvc" + " " * 30 + "123456"), catalog=c).count() == 0


def test_byte_offsets(spark):
    got = findings(docs(spark, "số thẻ 123456 và 654321"), catalog=rule(patterns=(Pattern(r"\b\d{6}\b", 0.9),))).orderBy("offset").collect()
    raw = "số thẻ 123456 và 654321".encode()
    assert [r["offset"] for r in got] == [raw.index(b"123456"), raw.index(b"654321")]


def test_comment_lines(spark):
    c = rule(patterns=(Pattern(r"\b\d{6}\b", 0.9),))
    assert findings(docs(spark, "# 123456", "x # 123456", "a\n  // 123456", ";123456", "#\n123456"), catalog=c).orderBy("doc_id").toPandas()["doc_id"].tolist() == [1, 4]


def test_exclusion_and_context(spark):
    c = rule(exclude_if_no_keywords=True, patterns=(Pattern(r"\b\d{6}\b", 0.9),))
    assert findings(docs(spark, "123456", "CVC" + " " * 500 + "123456"), catalog=c).toPandas()["doc_id"].tolist() == [1]


def test_escalation_override_and_validator_cap(spark):
    c = rule(patterns=(Pattern(r"\b\d{6}\b", 1.0, override="CONFIDENTIAL"),), escalation=("secret",), escalate_to="SECRET")
    got = findings(docs(spark, "123456", "123456" + " " * 294 + "secret", "123456" + " " * 295 + "secret"), catalog=c).orderBy("doc_id").collect()
    assert [r["level"] for r in got] == [2, 3, 2]
    card = findings(docs(spark, "card number 4111111111111111"), catalog=DEFAULT.only("credit_card_001")).first()
    assert card["confidence"] == pytest.approx(0.99) and card["preview"] == "4111****1111"


def test_unknown_validator_is_ignored(spark):
    assert findings(docs(spark, "123456"), catalog=rule(patterns=(Pattern(r"\b\d{6}\b", 0.9, validators=("nobody",)),))).first()["confidence"] == pytest.approx(0.9)


def test_null_and_empty_texts(spark):
    d = docs(spark, None, "")
    assert findings(d).count() == 0
    assert [r["level"] for r in document_levels(d, findings(d)).collect()] == ["PUBLIC", "PUBLIC"]


def test_chunks_keep_offsets_across_characters(spark):
    text = "é" * 50 + " 123456 " + "ü" * 50
    o = ScanOptions(chunk_bytes=64, overlap_bytes=32)
    c = rule(patterns=(Pattern(r"\b\d{6}\b", 0.9),))
    found = findings(docs(spark, text), catalog=c, options=o)
    assert {r["offset"] for r in found.collect()} == {text.encode().index(b"123456")}
    assert distinct_findings(found).count() == 1
    longer = docs(spark, *[(" 123456 é 654321" * k)[k:] for k in range(1, 40)])
    many = findings(longer, catalog=c, options=o)
    counts = {r["doc_id"]: r["count"] for r in distinct_findings(many).groupBy("doc_id").count().collect()}
    assert many.count() > sum(counts.values())
    assert {r["doc_id"]: r["match_count"] for r in document_levels(longer, many, catalog=c, options=o).collect() if r["match_count"]} == counts
    parts = chunk(docs(spark, text), "text", o).orderBy("chunk_idx").collect()
    raw = text.encode()
    assert all(raw[r["base_offset"] :].startswith(r["chunk"].encode()) for r in parts)


def test_chunk_bounds(spark):
    rows = spark.range(1).select(F.explode(bounds(F.lit(131073), 65536, 512)).alias("w")).select("w.*").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 65536), (1, 65024, 131072), (2, 130560, 131073)]


def test_entropy_needs_1024_bytes(spark):
    noise = "".join(chr(33 + (i * 37) % 90) for i in range(1023 - 7))
    c = rule(patterns=(Pattern(r"\b\d{6}\b", 0.9),))
    got = chunk_levels(findings(docs(spark, "123456 " + noise, "123456 " + noise + "x"), catalog=c), catalog=c).orderBy("doc_id").collect()
    assert [r["level"] for r in got] == [1, 2]


def test_compound_needs_every_condition_at_its_level(spark):
    rules = rule().rules + (Rule("other_001", "o", "financial", "CONFIDENTIAL", 1.0, 1, (Pattern("zzz", 0.9),)),)
    rules = (Rule("test_001", "t", "pii", "INTERNAL", 1.0, 1, (Pattern(r"\b\d{6}\b", 0.9),)),) + rules[1:]
    text = docs(spark, "123456 zzz")
    for least, level in (("CONFIDENTIAL", 2), (None, 3)):
        c = Catalog(rules, (Compound("both", ("pii", "financial"), "SECRET", least=least, violation="V"),))
        row = chunk_levels(findings(text, catalog=c), catalog=c).first()
        assert row["level"] == level and len(row["violations"]) == (level == 3)


def test_public_has_no_values(spark):
    assert not {"value", "context", "__chunk"} & set(public(findings(docs(spark, "x"))).columns)


def test_built_in_expressions_agree_with_re2(spark, duck):
    """All patterns, in Java and in RE2, over texts made to hit their edges."""
    texts = ["đ12 số 4111 1111 1111 1111x 4111-1111-1111-1111", "CVV2: 123, dCVV=1234 card security code-999", "ũ079000000001 079000000001ố 079000000001", "NỘI BỘ – hạn chế phổ biến; INTERNAL — Limited", "10.0.0.1 10.0.0.256 172.31.255.255 192.168.1.1.1", "a.b+c@acme.example, x@y.gov.vn ö@z.com", "Nguyễn Văn An; HỌ VÀ TÊN: Trần Thị Bích", "lương: 12.000.000 đồng 12tr salary 1,000,000\nincome x 3,000", "GB12WEST12345678901 GB12 WEST 1234 5678", "ung thư HIV viêm gan B C34.1 Q12", "PASSWORD = abcdé token: 'x1234567890'", "01/02/1990 1990-12-31 3 tháng 4 năm 2001 1999", "ſecret KB K12 RESTRICTED ſ"]
    texts += [t.upper() for t in texts] + [t.replace(" ", "\u000b") for t in texts]
    d = docs(spark, *texts)
    for n, _, _, p in DEFAULT.patterns():
        ours = [list(r[0]) for r in d.orderBy("doc_id").select(F.regexp_extract_all("text", F.lit(to_java(p.regex)), F.lit(0))).collect()]
        theirs = [duck.execute("SELECT regexp_extract_all(?, ?)", [t, p.regex]).fetchall()[0][0] for t in texts]
        assert ours == theirs, p.regex


def test_anchors_and_gates_are_necessary(spark):
    """No pattern matches a text that its own gates refuse."""
    d = docs(spark, "x").limit(0)
    from conftest import SMALL

    from sparksift.plans.oracle import seeded_sql

    d = spark.sql(seeded_sql().replace("FROM customer", "FROM {c}"), c=spark.read.parquet(f"{SMALL}/customer.parquet"))
    for _, _, _, p in DEFAULT.patterns():
        hit = d.where(F.col("text").rlike(to_java(p.regex)))
        if p.gate:
            assert hit.where(~F.col("text").rlike(p.gate)).count() == 0, p.regex
        if p.anchors:
            low = F.lower("text")
            any_ = F.lit(False)
            for a in p.anchors:
                any_ = any_ | F.contains(low, F.lit(a))
            assert hit.where(~any_).count() == 0, p.regex


def test_dialect_pieces():
    assert to_java(r"\d[\w-]") == "[0-9][0-9A-Za-z_-]"
    assert to_java(r"a.$") == r"a[^\n]\z"
    assert re.search("iu", to_java("(?i)x"))
