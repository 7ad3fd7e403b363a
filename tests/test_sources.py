"""Listing, extraction, decoding, sinks, rules from YAML, streams, SQL functions, command line."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sparksift.__main__ import main
from sparksift.functions.sql import register
from sparksift.operators import evaluate
from sparksift.operators.detect import findings
from sparksift.operators.html import visible_text
from sparksift.plans.scan import scan_files
from sparksift.rules.catalog import DEFAULT
from sparksift.rules.loader import load
from sparksift.sources import sinks
from sparksift.sources.extract import docx, eml, pdf, xlsx
from sparksift.sources.files import folder_labels, ground_truth, list_files, scan_results, walk
from sparksift.streaming.scan import findings_stream, windowed_counts


@pytest.fixture
def tree(tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / "sub").mkdir()
    for name, data in {".env": b"token = \"0123456789abcdef\"", "_x.txt": b"a", "a.TXT": b"card number 4111111111111111", "sub/b.csv": b"x,y", ".git/c.txt": b"no", "big.txt": b"z" * 100, "bin.dat": b"MZ\0\0", "utf16.dat": b"\xff\xfe" + "password: hunter22".encode("utf-16-le"), "latin.dat": "password: hünter22".encode("cp1252")}.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "link.txt").symlink_to(tmp_path / "a.TXT")
    return tmp_path


def test_listing(spark, tree):
    names = lambda df: sorted(r["path"].rsplit("/", 1)[1] for r in df.collect())
    assert names(list_files(spark, str(tree))) == [".env", "_x.txt", "a.TXT", "b.csv", "big.txt", "bin.dat", "latin.dat", "utf16.dat"]
    assert names(list_files(spark, str(tree), recursive=False, extensions=(".txt",), max_size=50)) == ["_x.txt", "a.TXT"]
    assert names(list_files(spark, str(tree / "a.TXT"))) == ["a.TXT"]
    assert list(walk(str(tree / "missing"))) == []


def test_scan_files(spark, tree):
    scan = scan_files(spark, str(tree), max_size=90)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in scan.results.collect()}
    assert rows["a.TXT"]["level"] == "RESTRICTED" and rows[".env"]["level"] == "RESTRICTED"
    assert rows["big.txt"]["status_code"] == 6 and rows["bin.dat"]["status_code"] == 5
    assert rows["utf16.dat"]["level"] == "PUBLIC" and rows["utf16.dat"]["status_code"] == 5  # too many NUL bytes
    assert rows["latin.dat"]["level"] == "RESTRICTED"
    assert scan.shown(1).count() == 3 and scan.shown(1, errors=True).count() == 6
    lines = [json.loads(r["value"]) for r in sinks.json_rows(scan.shown(1), "path").collect()]
    assert {x["level"] for x in lines} == {"RESTRICTED"}
    assert "scanned: 8" in sinks.summary(scan.results)
    assert sinks.wire(scan.results).where("error_code <> 0").count() == 0


def test_command_line(spark, tree, tmp_path_factory, capsys):
    out = tmp_path_factory.mktemp("out")
    assert main(["scan", "--path", str(tree), "--format", "jsonl", "--output", str(out / "r"), "--audit", str(out / "a")]) == 0
    assert spark.read.json(str(out / "a")).where("ts is not null").count() >= 3
    assert scan_results(spark, str(out / "r")).count() == 3
    assert main(["rules"]) == 0 and "25 rules" in capsys.readouterr().out
    (out / "c.yaml").write_text("scanner:\n  max_file_size: 4B\n  skip_dirs: [sub]\nrules:\n  min_confidence: 0.6\noutput:\n  audit_log: ''\n")
    assert main(["scan", "--path", str(tree), "--level", "PUBLIC", "--config", str(out / "c.yaml")]) == 0
    text = capsys.readouterr().out
    assert "sub/b.csv" not in text and "[SKIPPED_TOO_LARGE/PUBLIC]" in text and "scanned: 8" in text  # with .git, which the settings do not skip
    with pytest.raises(ValueError):
        main(["scan", "--path", str(tree), "--level", "WRONG"])


def test_text_and_evaluation_rows(spark):
    m = [("r_001", i, 4, 0.9) for i in range(5)]
    schema = "path string, status_code int, level string, error string, scan_duration_ms long, matches array<struct<rule_id:string,offset:long,length:int,confidence:double>>"
    d = spark.createDataFrame([("a", 1, "INTERNAL", None, 7, m), ("b", 1, "PUBLIC", None, 0, None), ("c", 2, "PUBLIC", "IOError: x", 1, None)], schema)
    a, b, c = (r["value"].split("\n") for r in sinks.text_rows(d, "path").collect())
    assert a == ["[OK/INTERNAL] a", "  matches: 5  duration: 7ms", *(f"  - r_001 conf=0.90 offset={i} len=4" for i in range(3)), "  ... and 2 more matches"]
    assert b[2:] == ["  no findings"] and c[0] == "[ERROR/PUBLIC] c" and c[2:] == ["  error: IOError: x"]
    assert len(sinks.text_rows(d, "path", 0).first()["value"].split("\n")) == 7
    pairs = spark.createDataFrame([("x", "PUBLIC", "SECRET", 3)], "k string, expected string, predicted string, duration_ms long")
    assert tuple(sinks.evaluation_rows(pairs, "k").first()) == ("x", "PUBLIC", "SECRET", False, False, "3.00", "")


def test_listing_is_shared_out(spark, tmp_path, monkeypatch):
    from sparksift.sources import files

    for k in range(40):
        folder = tmp_path / f"d{k % 7}" / f"e{k % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{k}.txt").write_text("x")
    want = sorted(r[0] for r in walk(str(tmp_path)))
    for most in (1, 4, 9, 512):
        monkeypatch.setattr(files, "FOLDERS", most)
        assert sorted(r["path"] for r in list_files(spark, str(tmp_path)).collect()) == want and len(want) == 40


def _zip(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, d in files.items():
            z.writestr(n, d)
    return b.getvalue()


def test_extractors():
    assert docx(_zip({"word/document.xml": "<d><p> Hello <r>world</r></p></d>"})) == "Hello\nworld"
    assert docx(_zip({"x": ""})) == ""
    book = {"xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>", "xl/worksheets/sheet1.xml": '<w><row><c t="s"><v>0</v></c><c><v>42</v></c><c/></row></w>'}
    assert xlsx(_zip(book)) == "name\n42"
    assert eml(b"To: b\r\nFrom: a\r\n\r\nbody") == "From: a\nTo: b\n\nbody"
    assert pdf(b"%PDF\nstream\nBT (4111 \\(x\\)) Tj [(a) 3 (b)] TJ ET\nendstream") == "4111 (x)\nab"
    with pytest.raises(ValueError):
        pdf(b"%PDF /Encrypt")
    assert visible_text("<p>a &amp; b<script>x</script><style>y</style><b> c </b>") == "a & b\nc"


def test_evaluation_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("path,expected_level,include_eval,notes\na.txt,CLEAN,true,x\nb.txt,L3,true\nc.txt,L4\n")
    assert ground_truth(spark, str(tmp_path / "t.csv")).count() == 2
    (tmp_path / "r.jsonl").write_text('{"path":"a","level_code":1}\n{"path":"a","level_code":2}\n')
    assert [r["level_code"] for r in scan_results(spark, str(tmp_path / "r.jsonl")).collect()] == [2]
    got = folder_labels(spark.createDataFrame([("x/L3_CONFIDENTIAL/a",), ("EDGE_CASES/b",)], "path string")).collect()
    assert [(r["expected"], r["is_edge"]) for r in got] == [("CONFIDENTIAL", False), (None, True)]


def test_evaluation_report(spark):
    pairs = spark.createDataFrame([(1, "PUBLIC", "PUBLIC"), (2, "SECRET", "PUBLIC"), (3, "PUBLIC", "INTERNAL"), (4, "SECRET", "SECRET")], "k int, expected string, predicted string")
    b = evaluate.binary_metrics(pairs).first()
    assert (b["tp"], b["fp"], b["fn"], b["accuracy"]) == (1, 1, 1, 0.5)
    text = "\n".join(evaluate.report(pairs, "k"))
    assert "| 2 | false-negative | SECRET | PUBLIC |" in text and "| CONFIDENTIAL | 0 |" in text
    assert evaluate.matched(pairs.select("k", "expected"), pairs.where("k = 1").select("k", "predicted"), "k").where("predicted = 'PUBLIC'").count() == 4


def test_yaml_rules(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("id: a_001\ncategory: pii\nlevel: SECRET\nweight: 1.0\npriority: 5\npatterns:\n  - regex: '\\bfoo\\d+\\b'\n    confidence: 0.9\nkeywords: [bar, baz]\n")
    (tmp_path / "b.yaml").write_text("id: b_001\nenabled: false\npatterns: []\n")
    (tmp_path / "rules.yaml").write_text("includes: [a.yaml, b.yaml]\ncompound_rules:\n  - name: n\n    conditions: [pii]\n    result_level: SECRET\n")
    c = load(tmp_path / "rules.yaml")
    assert [r.id for r in c.ordered()] == ["a_001"] and c.rules[0].keywords == [("bar", True), ("baz", True)]
    assert findings(spark.createDataFrame([(1, "foo12")], "doc_id int, text string"), catalog=c).first()["level"] == 3
    (tmp_path / "rules.yaml").write_text("includes: [missing.yaml]\n")
    with pytest.raises(FileNotFoundError):
        load(tmp_path / "rules.yaml")


def test_stream_equals_batch(spark, tmp_path):
    d = spark.createDataFrame([(1, "card number 4111111111111111"), (2, "nothing"), (3, "a@b.example.com")], "doc_id long, text string")
    d.write.parquet(str(tmp_path / "in"))
    stream = findings_stream(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("found").start()
    try:
        q.processAllAvailable()
        key = lambda df: sorted((r["doc_id"], r["rule_id"], r["offset"], r["level"]) for r in df.collect())
        assert key(spark.table("found")) == key(findings(d)) != []
    finally:
        q.stop()


def test_stream_windows(spark, tmp_path):
    e = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id*20,0) AS ts, 'a' AS t FROM range(9)")
    e.write.parquet(str(tmp_path / "ev"))
    q = windowed_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "ev")), "ts", "t").writeStream.format("memory").queryName("win").outputMode("complete").start()
    try:
        q.processAllAvailable()
        assert sorted(r["n"] for r in spark.table("win").collect()) == sorted(r["n"] for r in windowed_counts(e, "ts", "t").collect()) == [3, 3, 3]
    finally:
        q.stop()


def test_sql_functions(spark):
    assert "luhn_valid" in register(spark)
    row = spark.sql("SELECT luhn_valid('4111-1111-1111-1111') a, luhn_valid('4111') b, cccd_valid('079000000001') c, bank_valid('101400000001') d, mask_preview('123456789') e, level_label(3) f, rule_prefix('a_b_001') g").first()
    assert tuple(row) == (True, False, True, True, "1234****6789", "RESTRICTED", "a_b")


def test_page_text_hits_brute_force(spark):
    from conftest import SMALL

    from sparksift.queries import QUERIES

    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html").collect()
    texts = spark.createDataFrame([(r["page_id"], visible_text(r["html"])) for r in pages], "doc_id long, text string")
    key = lambda df: sorted((r["doc_id"], r["rule_id"], r["offset"], r["length"]) for r in df.collect())
    assert key(findings(texts, catalog=DEFAULT)) == key(QUERIES["page_text_hits"](spark, SMALL))


def test_catalogue_is_complete():
    assert len(DEFAULT.ordered()) == 25 and len(DEFAULT.compounds) == 20
    assert F is not None
