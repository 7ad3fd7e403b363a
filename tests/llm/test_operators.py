"""Each operator against a brute-force statement of what it returns, and its corner cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from conftest import SMALL, compare
from pyspark.sql import functions as F

import corpus_pipeline
from sparksift.llm import exact_dedup, language_id, line_dedup, minhash, mixing, ngram, packing, quality, queries, sharding, url_filter
from sparksift.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, n int, kept string, th long"


def low(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


def words_of(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["the", "of", "and", "alpha", "beta", "gamma", "delta", "Epsilon", "zeta", "éta", "theta", "iota"]) + str(rng.randrange(40)) * (rng.random() < 0.5) for _ in range(n))


def corner_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, repeated rows and ids, ties, copies, a long text, columns with clashing names."""
    rng = random.Random(5)
    long_text = "\n".join(words_of(rng, 12) for _ in range(900))
    line = "This very line is shared by many documents, as license lines are."
    texts = [None, "", " \n\t ", "a", "a  b c d e f", "a b c d\te f", long_text, long_text + " tail", None, "x" * 3000]
    rows = [(i, t, "en", "s1") for i, t in enumerate(texts)]
    rows += [(100 + i, f"{line}\n{words_of(rng, 30)}\n{line.upper()}", "fr", f"s{i % 3}") for i in range(8)]
    rows += [(200, "same id one", "en", "s1"), (200, "same id two", "en", "s1"), (201, "twice the same row", "en", None), (201, "twice the same row", "en", None)]
    rows += [(None, "no id here", None, None), (None, "no id here", None, None), (None, None, None, None), (300, "### $$$ %%% 123", None, "s2")]
    return [(*r, 1, 7, "k", 3, "no", 9) for r in rows]


@pytest.fixture(scope="module")
def corner(spark):
    return spark.createDataFrame(corner_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, name):
    compare(queries.queries()[name](spark, SMALL), duck.sql(queries.oracle_sql()[name]))


# 1: exact dedup


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[ \t-\r]+", " ", t or "")].append(i)
    return groups


def check_dedup(got, rows):
    groups = brute_groups(rows)
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["text_sha256"]].append(r)
    for text, ids in groups.items():
        rs = by[hashlib.sha256(text.encode()).hexdigest()]
        keep = min((i for i in ids if i is not None), default=None)
        assert len(rs) == len(ids) and {r["group_size"] for r in rs} == {len(ids)} and {r["keep_id"] for r in rs} == {keep}
        assert sum(r["kept"] for r in rs) == 1 and [r["doc_id"] for r in rs if r["kept"]] == [keep]


def test_exact_dedup_corners(corner, empty):
    rows = [(r["doc_id"], r["text"]) for r in corner.collect()]
    check_dedup(exact_dedup.exact_dedup(corner).collect(), rows)
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.drop_copies(corner)
    assert kept.columns == corner.columns and kept.count() == len(brute_groups(rows))


def test_exact_dedup_survives_collisions(corner):
    """With tiny primes nearly all texts of a length collide; the comparison tells them apart."""
    rows = [(r["doc_id"], r["text"]) for r in corner.collect()]
    check_dedup(exact_dedup.exact_dedup(corner, primes=(2, 2), bases=(1, 1), chunk_bytes=64).collect(), rows)


def test_fingerprints_compose(spark):
    data = np.frombuffer(bytes(range(256)) * 9, np.uint8)
    whole = exact_dedup.fingerprint(data, [exact_dedup.powers(b, p, 4096) for b, p in zip(exact_dedup.BASES, exact_dedup.PRIMES)])
    parts = exact_dedup.fingerprint(data, [exact_dedup.powers(b, p, 100) for b, p in zip(exact_dedup.BASES, exact_dedup.PRIMES)])
    assert whole == parts
    rows = [(1, k, bytearray(data[a : a + 500])) for k, a in enumerate(range(0, len(data), 500))]
    got = exact_dedup.combine_chunks(spark.createDataFrame(rows, "d long, chunk_no int, chunk binary").repartition(4), "d").first()
    assert (got["fp1"], got["fp2"], got["n_bytes"]) == (*whole, len(data))


# 2: packing


def check_packing(got, texts, capacity=1024):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_vocabulary()[0])
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for i, ts in texts.items():
        want = []
        for t in ts:
            ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
            first = len(ids) % capacity or capacity
            cuts = [0, *range(first, len(ids) + 1, capacity)]
            want += [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by[i]) == sorted(want)
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs), -(-sum(r["length"] for r in got) // capacity)


def test_packing(documents, corner, empty):
    texts = defaultdict(list)
    for r in documents.collect():
        texts[r["doc_id"]].append(r["text"])
    n, least = check_packing(packing.pack(documents).collect(), texts)
    assert n <= least * 1.02 + 1
    texts = defaultdict(list)
    for r in corner.collect():
        texts[r["doc_id"]].append(r["text"])
    check_packing(packing.pack(corner).collect(), texts)
    assert packing.pack(empty).count() == 0


def test_crossover_keeps_every_item():
    rng = random.Random(1)
    sizes = sorted((rng.randint(1, 1023) for _ in range(300)), reverse=True)
    a = packing.packed(range(300), sizes, 1024)
    b = packing.packed(rng.sample(range(300), 300), sizes, 1024)
    for _ in range(10):
        c = packing.crossover(a, b, rng)
        assert sorted(i for x in c.items for i in x) == list(range(300))
        assert all(sum(sizes[i] for i in x) + f == 1024 and f >= 0 for x, f in zip(c.items, c.free))
    assert len(packing.evolve(sizes, 1024, [], 3, 10)[0].items) <= len(a.items)


def test_genetic_packing_beats_best_fit(spark):
    """Triplets that fill a sequence exactly: best-fit-decreasing needs 2 % more than the bound at least; crossover finds a better packing, also as islands with migration."""
    rng = random.Random(0)
    sizes = []
    for _ in range(100):
        a = rng.randint(390, 500)
        b = min(rng.randint(256, 1024 - 256 - a + 2), 1024 - a - 1)
        sizes += [a, b, 1024 - a - b]
    ordered = sorted(sizes, reverse=True)
    fit = len(packing.packed(range(300), ordered, 1024).items)
    assert fit > 1.02 * 100 and len(packing.evolve(ordered, 1024, [], 1, 60)[0].items) < fit
    docs = spark.createDataFrame([(i, "a" + " a" * (n - 2)) for i, n in enumerate(sizes)], "doc_id long, text string")
    got = packing.pack(docs, islands=3, epochs=3, generations=30).collect()
    n, least = check_packing(got, {i: ["a" + " a" * (n - 2)] for i, n in enumerate(sizes)})
    assert least == 100 and n < fit


def test_slow_encoder_is_loaded_when_needed():
    """Python workers outlive their tasks beside the executor's heap, so what few texts need isn't held for all."""
    encode = packing.make_encoder(packing.default_vocabulary())
    held = lambda: dict(zip(encode.__code__.co_freevars, encode.__closure__))["slow"].cell_contents
    assert len(encode("plain words")) == 8 and held() is None
    assert encode("x" * 3000) and held() is not None


def test_encoders_agree():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_vocabulary()[0])
    encode = packing.make_encoder(packing.default_vocabulary())
    rng = random.Random(2)
    for t in ["<|endoftext|> x", "hello <|endoftext|> x", "١٢٣ Ⅷ 你好 \U0001f600 it's", "x" * 5000, " " * 5000 + "a", *("".join(rng.choice("ab \n\t'sé1 #.Z") for _ in range(30)) for _ in range(300))]:
        assert np.frombuffer(encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


# 3: language identification


def test_language_id(documents, corner, empty):
    got = {r["doc_id"]: r for r in language_id.identify_documents(documents).collect()}
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    assert len(got) == len(truth) and np.mean([got[i]["lang"] == truth[i] for i in truth]) > 0.97 and np.mean([r["kept"] for r in got.values()]) > 0.98
    rows = language_id.identify_documents(corner).collect()
    assert len(rows) == corner.count()
    by = defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add((r["lang"], r["kept"]))
    assert by[0] == by[1] == by[300] == {("und", False)}
    assert language_id.identify_documents(empty).count() == 0
    kept = language_id.keep_identified(corner)
    assert kept.columns == corner.columns and kept.where("doc_id in (0, 1, 300)").count() == 0


def test_held_out_language_accuracy(documents):
    """Models of even documents identify odd ones."""
    langs, table = language_id.fit(documents.where("doc_id % 2 = 0"), "doc_id", "text", "lang", 1000)
    odd = documents.where("doc_id % 2 = 1")
    got = language_id.identify(language_id.documents_rows(odd), langs, table).join(odd.select(F.col("doc_id").alias("id"), F.col("lang").alias("truth")), "id")
    assert got.where("lang = truth").count() / odd.count() > 0.95


def test_text_likelihood_brute_force(spark):
    texts = ["abc def", "", "xy", "Ünïcode text", "1234 ###", "last one", "", ""]
    table = np.random.default_rng(0).normal(size=(language_id.BUCKETS, 3)).astype(np.float32)
    table[language_id.BLANK] = 0
    d = spark.createDataFrame(list(enumerate(texts)), "id long, txt string").coalesce(1)
    for r, t in zip(language_id.text_likelihoods(d, ["a", "b"], table).orderBy("id").collect(), texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        want = table[language_id._buckets(raw)].sum(axis=0) if len(raw) >= 3 else np.zeros(3)
        assert r["ll"] == pytest.approx(want.tolist(), abs=1e-4)


def test_pages_evidence(spark):
    rows = [(1, "https://a.example.com/x", '<html lang="fr"><script>the the</script><p>le la &amp; de</p>'), (2, None, None), (3, "https://A.example.com", "")]
    got = {r["id"]: r for r in language_id.pages_rows(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1]["host"], got[1]["domain"], got[1]["suffix"], got[1]["declared"], got[1]["txt"].strip()) == ("a.example.com", "example.com", "com", "fr", "le la de")
    assert got[2]["host"] is None and got[3]["host"] == "a.example.com" and got[3]["declared"] is None


def brute_posteriors(rows, langs, table):
    """The fusion of all evidence for rows (id, host, domain, suffix, declared, text), as the module's docstring states it."""
    k, share = len(langs) + 1, language_id.STRENGTH
    names = [*langs, "und"]
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    ll = []
    for r in rows:
        raw = np.frombuffer(r[5].encode(), np.uint8)
        ll.append(table[language_id._buckets(raw)].astype(float).sum(axis=0) if len(raw) >= 3 else np.zeros(k))
    prior = np.log([(1 - language_id.UND_PRIOR) / (k - 1)] * (k - 1) + [language_id.UND_PRIOR])
    q = [soft(x * language_id.TEMPER + prior) for x in ll]
    said = [r[4] if r[4] in langs else r[4] and "other" for r in rows]
    total = sum(q)
    world = (total + 1e-3) / (total + 1e-3).sum()
    add = lambda key: {v: (sum(q[i] for i in at), len(at)) for v in {key(r) for r in rows} for at in [[i for i, r in enumerate(rows) if key(r) == v]]}
    hosts, domains, suffixes = add(lambda r: r[1:4]), add(lambda r: r[2:4]), add(lambda r: r[3])
    out = {}
    for i, r in enumerate(rows):
        up = (suffixes[r[3]][0] + share * world) / (suffixes[r[3]][1] + share)
        up = (domains[r[2:4]][0] + share * up) / (domains[r[2:4]][1] + share)
        own = (hosts[r[1:4]][0] - q[i] + share * up) / (hosts[r[1:4]][1] - 1 + share)
        mark = np.log((sum(q[j] for j in range(len(rows)) if said[j] == said[i]) + 1) / (total + len(set(said))))
        post = soft(ll[i] * language_id.TEMPER + np.log(np.maximum(own, 1e-6)) + mark)
        out[r[0]] = (names[post.argmax()] if abs(ll[i]).sum() > 0 else "und", post.max(), names[q[i].argmax()] if abs(ll[i]).sum() > 0 else "und")
    return out


def _rows(spark, rows):
    return spark.createDataFrame([(*r[:1], 0, *r[1:]) for r in rows], "id long, th long, host string, domain string, suffix string, declared string, txt string").repartition(3)


def test_posteriors_brute_force(spark):
    rng = random.Random(3)
    table = np.random.default_rng(1).normal(-9, 1, size=(language_id.BUCKETS, 4)).astype(np.float32)
    table[language_id.BLANK] = 0
    langs = ["aa", "bb", "cc"]
    places = [("x.a.com", "a.com", "com"), ("y.a.com", "a.com", "com"), ("b.com", "b.com", "com"), ("c.org", "c.org", "org"), (None, None, None)]
    rows = [(i, *rng.choice(places), rng.choice([None, "aa", "bb", "zz"]), "".join(rng.choice("abcdef ") for _ in range(rng.choice([0, 2, 5, 20])))) for i in range(30)]
    want = brute_posteriors(rows, langs, table)
    got = {r["id"]: r for r in language_id.identify(_rows(spark, rows), langs, table).collect()}
    assert len(got) == 30
    for i, (lang, post, text_lang) in want.items():
        assert (got[i]["lang"], got[i]["text_lang"]) == (lang, text_lang), (rows[i], got[i], want[i])
        assert got[i]["posterior"] == pytest.approx(post, abs=1e-5)
        assert got[i]["kept"] == (lang != "und" and post >= 0.3)


def test_host_and_declaration_overturn_the_text(spark):
    """A short text that leans to one language, at a host of the other, or declaring the other as its like do."""
    table = np.full((language_id.BUCKETS, 3), -10.0, np.float32)
    table[:, 2] = -12.0
    at = lambda t: language_id._buckets(np.frombuffer(t.encode(), np.uint8))
    table[at("aaaa"), 0], table[at("bbbb"), 1] = -4.0, -4.0
    lean = "zaaaz"
    table[at("zaa"), 0] = table[at("zaa"), 1] = -10.0
    rows = [(i, "a.com" if i < 40 else "b.com", "d.com" if i < 40 else "e.com", "com", "bb" if i >= 80 else None, ("a" if i < 40 else "b") * 40) for i in range(120)]
    rows += [(1000, "a.com", "d.com", "com", None, lean), (1001, "b.com", "e.com", "com", None, lean), (1002, None, None, None, "bb", lean), (1003, None, None, None, None, lean)]
    table[at("aaa"), 0] = -8.0
    got = {r["id"]: r for r in language_id.identify(_rows(spark, rows), ["aa", "bb"], table).collect()}
    assert [got[i]["text_lang"] for i in (1000, 1001, 1002, 1003)] == ["aa"] * 4
    assert [got[i]["lang"] for i in (1000, 1001, 1002)] == ["aa", "bb", "bb"]


def test_junk_has_no_language(spark, documents):
    rng = random.Random(2)
    langs, table = language_id.fit(documents, "doc_id", "text", "lang", 1000)
    assert langs == sorted({r["lang"] for r in documents.select("lang").distinct().collect()})
    junk = ["".join(rng.choice("qxzjkvwpf#@0123456789 ") for _ in range(300)) for _ in range(20)] + ["12 34 $$$ ###", "=" * 500, "٣٤٥ 漢字かな交じり文" * 5]
    got = language_id.identify(_rows(spark, [(i, None, None, None, None, t) for i, t in enumerate(junk)]), langs, table).collect()
    assert not any(r["kept"] for r in got)


def test_every_labelled_language_has_a_class(spark):
    rows = [(i, f"{chr(97 + i % 9)}{chr(97 + i // 9)}{chr(110 + i % 7)} " * 9, f"l{i:03d}" if i < 90 else None) for i in range(99)] + [(500 + i, "tho then thing " * 3, "l000") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, table = language_id.fit(d, "doc_id", "text", "lang", 5)
    assert langs == [f"l{i:03d}" for i in range(90)] and table.shape == (language_id.BUCKETS, 91)
    got = {r["doc_id"]: r["lang"] for r in language_id.identify_documents(d.withColumn("source", F.lit("s")), fit_rows=5).collect()}
    assert len(got) == 399 and np.mean([got[i] == f"l{i:03d}" for i in range(1, 90)]) > 0.9


def test_pages_corners(spark, documents):
    """Null, empty and repeated pages, columns with clashing names, an empty table."""
    langs, table = language_id.fit(documents, "doc_id", "text", "lang", 50)
    text = documents.first()["text"]
    rows = [(1, None, None), (2, "", ""), (3, "http://a.com", f"<html lang=en>{text}</html>"), (3, "http://a.com", f"<html lang=en>{text}</html>"), (None, "x", text), (4, "http://b.org/" + "x" * 5000, text * 200)]
    pages = spark.createDataFrame([(*r, "h", 1, "l") for r in rows], "page_id long, url string, html string, host string, n int, lang string")
    got = language_id.identify(language_id.pages_rows(pages), langs, table).collect()
    assert len(got) == 6 and sorted((str(r["id"]), r["lang"] != "und") for r in got) == [("1", False), ("2", False), ("3", True), ("3", True), ("4", True), ("None", True)]
    assert language_id.identify(language_id.pages_rows(pages.limit(0)), langs, table).count() == 0


# 4: line dedup


def brute_lines(rows, min_chars=40, min_docs=5):
    strip = " \t\n\x0b\x0c\r"
    docs, last = defaultdict(int), {}
    for i, t in rows:
        for k in {low(x.strip(strip)) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                docs[k] += 1
                if i is not None:
                    last[k] = max(i, last.get(k, i))
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        keep = [x for x in ls if not (docs.get(low(x.strip(strip)), 0) >= min_docs and low(x.strip(strip)) in last and (i is None or i < last[low(x.strip(strip))]))]
        out.append((str(i), len(ls), len(ls) - len(keep), "\n".join(keep)))
    return sorted(out)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_line_dedup(corner, empty, monkeypatch, limit):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", limit)
    rows = [(r["doc_id"], r["text"]) for r in corner.collect()]
    got = line_dedup.line_dedup(corner)
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()) == brute_lines(rows)
    assert line_dedup.line_dedup(empty).count() == 0


# 5: url filters


def judge(u, list_rules, pattern_rules):
    """Every rule tried on the url."""
    at = (u or "").find("://")
    rest = u[at + 3 :] if at >= 0 else ""
    host = low(re.match(r"[^/?#]*", rest).group())
    path = re.match(r"[^/?#]*([^?#]*)", rest).group(1)
    fits = [r for r in list_rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.text), r.text, r.verdict), default=None)
    pattern = next((p for p in pattern_rules if re.search(p.regex, low(u or ""))), None) if best is None else None
    return host, path, best.text if best else None, best.verdict if best else pattern.verdict if pattern else "allow", pattern.name if pattern else None


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/1?x#y", "http://notexample.org/es/", "http://org/", "http://a.com/fr/x", "http://a.com/de", "http://a.com/de/", "https://cheap-pills.example.net/a", "https://carefree-bets.example.net/", "http://x.net/casino/", "http://x.net/xcasino", "http://x.net/a.zip", "http://x.net?sessionid=" + "a" * 20, "éhttp://É.org/\nx", "http://x.net/casino/", "http://x.net/a/login?x", "http://x.net/login", "http://" + "a." * 40 + "net/" + "p/" * 20_000 + "login#"]
    d = spark.createDataFrame([(i if i else None, u, "c", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, rank int")
    got = url_filter.url_filter(d).collect()
    assert len(got) == len(urls)
    for u in urls:
        assert judge(u, url_filter.LIST_RULES, url_filter.PATTERN_RULES) in {(r["host"], r["path"], r["rule"], r["verdict"], r["pattern"]) for r in got}, u
    assert url_filter.url_filter(d.limit(0)).count() == 0
    assert url_filter.url_filter(d, list_rules=(), pattern_rules=()).where("verdict = 'allow'").count() == len(urls)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_thousands_of_url_rules(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", limit)
    rng = random.Random(11)
    name = lambda k: f"h{k}"
    lists = "# hosts\n" + "\n".join(f"{rng.choice(('allow', 'block'))} {rng.choice(('', 'www.', 'a.b.'))}{name(rng.randrange(900))}.example.net{rng.choice(('', '/', '/en/', '/en/1', f'/en/{k}', '/a/long/path/'))}" for k in range(3000))
    patterns = "\n".join(f"p{k}\tblock\t{rng.choice(('[/.-]', ''))}t{rng.randrange(400)}{rng.choice(('[/.-]', '(?:x|y)?/', '[0-9]+', '$'))}" for k in range(2000))
    list_rules, pattern_rules = url_filter.read_list(lists), url_filter.read_patterns(patterns)
    urls = [f"http://{rng.choice(('', 'www.', 'a.b.', 'z.'))}{name(rng.randrange(1800))}.example.net/{rng.choice(('', 'en/', 'en/12', 'a/long/path/x', f't{rng.randrange(400)}', f't{rng.randrange(400)}/x'))}" for _ in range(300)]
    indexed = tuple(p for p in pattern_rules if url_filter.literal_tokens(p.regex))
    assert len(indexed) > 300
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_filter.url_filter(d, list_rules=url_filter.list_table(spark, list_rules), pattern_rules=indexed).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"], r["pattern"]) == judge(urls[r["page_id"]], list_rules, indexed)


def test_rare_tokens():
    t = url_filter.literal_tokens
    assert t(r"[/.]cheap-pills\.") == [["cheap", "pills"]] and t(r"x?free-bets") == [] and t(r"\.(?:zip|exe)$") == [["exe"], ["zip"]]
    assert t(r"/login[?#/]") == t(r"://[^/?#]*/(?:[^?#]*/)?login[?#/]") == [["login"]]
    assert t(r"/a(?=b)") == t(r"/[a-z]/") == t(r"/x(?:y|)z*/") == t(r"(?:/a/|b)") == [] and t(r"/ab?c/") == [["abc"], ["ac"]] and t(r"/v+[.]a\b") == [["a"]]
    assert all(t(r.regex) for r in url_filter.PATTERN_RULES)
    with pytest.raises(ValueError):
        url_filter.read_patterns("a\tmaybe\tx")
    with pytest.raises(ValueError):
        url_filter.read_list("permit a/b")


# 6: quality


def brute_counts(t):
    w = WORD.findall(t or "")
    c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    m = {j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    ls = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(ls) - len(set(ls)), len(m)


def test_quality(spark, documents, corner, empty):
    for d in (documents, corner):
        want = sorted((str(r["doc_id"]), *brute_counts(r["text"])) for r in d.collect())
        got = quality.quality(d).collect()
        assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
        assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got)
    assert quality.quality(empty).count() == 0


def test_outliers_are_found(spark):
    rng = random.Random(4)
    rows = [(i, words_of(rng, rng.randint(20, 200)), "en", f"s{i % 2}") for i in range(900)] + [(10_000 + i, " | ".join(words_of(rng, 40).split()), "en", "s0") for i in range(40)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(900)) and not any(got[10_000 + i] for i in range(40))


def test_junk_of_nearly_half_a_source_is_found(spark):
    """Spam of 30, 40 or 45 % of a source's rows is outside its core; clean rows stay."""
    rng = random.Random(6)
    rows = []
    for s, share in enumerate((0.30, 0.40, 0.45)):
        for i in range(500):
            n = rng.randint(30, 120)
            junk = i < 500 * share
            text = " ".join(w + "#" * rng.randint(0, 3) for w in words_of(rng, n).split()) if junk else words_of(rng, n)
            rows.append((s * 1000 + i, text, "en", f"s{s}", junk))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, junk boolean")
    got = {r["doc_id"]: r for r in quality.quality(d).collect()}
    for s in range(3):
        mine = [(got[r[0]]["kept"], r[4]) for r in rows if r[3] == f"s{s}" and not got[r[0]]["base_failed"]]
        assert sum(j for _, j in mine) / len(mine) > (0.28, 0.38, 0.43)[s]
        assert np.mean([k for k, j in mine if j]) < 0.05 and np.mean([k for k, j in mine if not j]) > 0.98


def brute_mcd(x, core=quality.CORE):
    """FAST-MCD with numpy: 200 random starts of DIMS + 1 rows, steps until the determinant stops falling, the least, reweighted; with the operator's floors and factors."""
    rng = np.random.default_rng(0)
    floors = np.diag(np.square(quality.FLOORS))
    h = math.ceil(core * len(x))
    moments = lambda y, f: (y.mean(axis=0), np.cov(y.T, bias=True) * f + floors)
    far = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    best = None
    for _ in range(200):
        m, c = moments(x[rng.choice(len(x), quality.DIMS + 1, replace=False)], 1.0)
        det = math.inf
        while True:
            m, c = moments(x[np.argsort(far(m, c))[:h]], quality.consistency(core, quality.DIMS))
            new = np.linalg.slogdet(c)[1]
            if new >= det - 1e-9:
                break
            det = new
        if best is None or det < best[0]:
            best = (det, m, c)
    d = far(*best[1:])
    m, c = moments(x[d <= quality.quantile(quality.WEIGHTED, quality.DIMS)], quality.consistency(quality.WEIGHTED, quality.DIMS))
    return m, c, far(m, c)


@pytest.mark.parametrize("share", [0.0, 0.2, 0.4])
def test_verdicts_agree_with_brute_force(spark, share):
    """300 rows of a group with contamination: location, scatter and verdicts of an exhaustive estimate."""
    rng = np.random.default_rng(3)
    x = rng.multivariate_normal([5, 1, 0.5, 0.2], np.eye(4) * 0.2 + 0.1, 300)
    bad = np.arange(300) < 300 * share
    x[bad] += rng.normal([2, 6, 0, 4], 1.0, (bad.sum(), 4))
    rows = [("a", "b", *map(float, r)) for r in x]
    e = quality.estimates(spark.createDataFrame(rows, "lang string, source string, x0 double, x1 double, x2 double, x3 double").repartition(3)).first()
    low_ = np.array([[e[f"l{i}{j}"] if j <= i else 0 for j in range(4)] for i in range(4)])
    m, c, d = brute_mcd(x)
    assert [e[k] for k in quality.M] == pytest.approx(m.tolist(), abs=0.05) and low_ @ low_.T == pytest.approx(c, abs=0.05)
    z = np.linalg.solve(low_, (x - [e[k] for k in quality.M]).T)
    ours = (z * z).sum(axis=0)
    assert ((ours > quality.CUTOFF) == (d > quality.CUTOFF)).mean() > 0.99
    assert (ours[bad] > quality.CUTOFF).mean() > 0.9 if share else (ours > quality.CUTOFF).sum() == 0


def test_small_groups_use_their_language(spark):
    """Fewer than LEAST_ROWS rows: the language's estimate, or that of all rows."""
    rng = np.random.default_rng(5)
    rows = [(lang, s, *map(float, rng.normal(k, 0.3, 4))) for lang, s, n, k in (("en", "big", 400, 1), ("en", "few", 20, 3), ("xx", None, 10, 2), (None, "big", 5, 2)) for _ in range(n)]
    got = {(r["lang"], r["source"]): r for r in quality.estimates(spark.createDataFrame(rows, "lang string, source string, x0 double, x1 double, x2 double, x3 double")).collect()}
    assert {k: (r["level"], r["n"], r["group_rows"]) for k, r in got.items()} == {("en", "big"): (2, 400, 400), ("en", "few"): (1, 420, 20), ("xx", None): (0, 435, 10), (None, "big"): (0, 435, 5)}


# 7: near duplicates


def brute_classes(rows, threshold=0.8):
    bags = []
    for _, t in rows:
        w = WORD.findall(t or "")
        bags.append(Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both, either = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
            if (either == 0) or both >= threshold * either:
                parent[find(a)] = find(b)
    out = defaultdict(list)
    for i, r in enumerate(rows):
        out[find(i)].append(r[0])
    return sorted(sorted(map(str, v)) for v in out.values())


@pytest.mark.parametrize("limit", [200_000, 0])
def test_near_duplicates(corner, empty, monkeypatch, limit):
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", limit)
    rows = [(r["doc_id"], r["text"]) for r in corner.collect()]
    got = minhash.near_duplicates(corner).collect()
    assert len(got) == len(rows)
    assert sum(r["kept"] for r in got) == len(brute_classes(rows))
    shown = lambda i: i not in (None, 200)  # noqa: E731 - ids that stand for several texts
    by = defaultdict(list)
    for r in got:
        if shown(r["doc_id"]):
            by[r["class_id"]].append(str(r["doc_id"]))
    want = [[i for i in c if i not in ("None", "200")] for c in brute_classes(rows)]
    assert sorted(map(sorted, by.values())) == sorted(c for c in want if c)
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.drop_near_duplicates(corner)
    assert kept.columns == corner.columns and kept.count() == len(brute_classes(rows))


def test_chains_and_shared_buckets(spark):
    """Near copies in a chain: neighbours are similar, ends are not; no link may be lost."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for k in range(30):
        base = list(base)
        base[(k * 9) % 300] = f"n{k}"
        rows.append((k, " ".join(base)))
    rows += [(100 + k, words_of(rng, 50)) for k in range(20)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    by = defaultdict(list)
    for r in got:
        by[r["class_id"]].append(str(r["doc_id"]))
    assert sorted(map(sorted, by.values())) == brute_classes(rows)


@pytest.mark.parametrize("group", [5_000, 7])
def test_template_gives_no_pairs(spark, monkeypatch, group):
    """Pages of one template that differ by more than the threshold share buckets, but few pairs are compared; copies among them are found."""
    monkeypatch.setattr(minhash, "GROUP_ROWS", group)
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(240)]
    rows = [(k, " ".join(base + [f"p{k}_{i}" for i in range(45)])) for k in range(200)]
    for k in range(30):  # near copies of pages, some of one another
        words = rows[k % 12][1].split()
        words[260 + k % 5] = f"c{k}"
        rows.append((1000 + k, " ".join(words)))
    seen = []
    real = minhash.verified
    monkeypatch.setattr(minhash, "verified", lambda pairs, *x: (seen.append(pairs.count()), real(pairs, *x))[1])
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    by = defaultdict(list)
    for r in got:
        by[r["class_id"]].append(str(r["doc_id"]))
    assert sorted(map(sorted, by.values())) == brute_classes(rows)
    assert sum(seen) < 2 * len(rows)


def test_across_finds_every_pair(spark):
    """Against all pairs, over random multisets of many sizes with shared parts."""
    rng = np.random.default_rng(7)
    parts = [rng.integers(0, 2**40, 40) for _ in range(12)]
    sets = []
    for k in range(150):
        x = np.unique(np.concatenate([*(parts[i] for i in rng.choice(12, 3, replace=False)), rng.integers(0, 2**40, rng.integers(0, 60))]))
        sets.append((k, int(rng.integers(0, 80)), [int(v) for v in rng.permutation(x)]))
        if k % 3 == 0:
            sets.append((1000 + k, 500 + k, [int(v) for v in rng.permutation(x)[: int(len(x) * 0.9)]]))
    d = spark.createDataFrame([(i, c, len(x), x) for i, c, x in sets], "nid long, comp long, n long, items array<long>")
    got = {(r["a"], r["b"]) for r in minhash.across(d.repartition(3), 0.8).collect()}
    want = set()
    for i, c, x in sets:
        for j, e, y in sets:
            if i < j and c != e and len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y)):
                want.add((i, j))
    assert want and want <= got and len(got) < len(sets) * 8


def test_signatures_are_unbiased():
    """The share of equal registers estimates the weighted Jaccard similarity, weights beyond one included."""
    rng = np.random.default_rng(3)
    for ca, cb in (([1] * 40 + [0] * 10, [1] * 30 + [0] * 10 + [1] * 10), ([5] * 20, [3] * 20), ([1, 7, 100], [2, 7, 60])):
        ca, cb = np.array(ca), np.array(cb)
        equal = []
        for _ in range(60):
            items = rng.integers(1, 2**62, len(ca)).astype(np.uint64)
            a, b = (minhash.bag_minhash(items[c > 0], c[c > 0], np.zeros((c > 0).sum(), np.int64), 1, 96)[0] for c in (ca, cb))
            equal.append((a == b).mean())
        assert np.mean(equal) == pytest.approx(np.minimum(ca, cb).sum() / np.maximum(ca, cb).sum(), abs=0.03)


def test_components(spark):
    links = [(1, 2), (2, 3), (7, 3), (10, 11), (11, 12), (20, 21), *[(100 + i, 101 + i) for i in range(40)]]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[x] for x in (1, 2, 3, 7)} == {1} and {got[x] for x in (10, 11, 12)} == {10} and {got[100 + i] for i in range(41)} == {100}


# 8: sharding


def check_shards(got, rows):
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(16)) and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding(spark, documents, corner, empty):
    for d in (documents, corner):
        check_shards(sharding.shard_by_bytes(d).collect(), [(r["doc_id"], r["text"]) for r in d.collect()])
    assert sharding.shard_by_bytes(empty).count() == 0
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 99) + str(i)) for i in range(20_000)] + [(50_000 + i, "hot copy " * 5) for i in range(8_000)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).toPandas()
    check_shards(got.to_dict("records"), rows)
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 16 and sums.max() / sums.mean() < 1.01 and sums.min() / sums.mean() > 0.99
    cold = got[got["doc_id"] < 50_000].groupby("text_crc32")["shard"].nunique()
    assert cold.max() == 1


# 9: mixing


def water_fill(sizes, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        unit = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * unit > most * sizes[s]}
        if not over:
            return target | {s: w[s] * unit for s in open_}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("leaf", [256, 4])
def test_mixing(documents, corner, empty, monkeypatch, leaf):
    monkeypatch.setattr(mixing, "LEAF_ITEMS", leaf)
    for d in (documents, corner):
        rows = [(r["doc_id"], r["text"], r["source"]) for r in d.collect()]
        sizes = defaultdict(int)
        for _, t, s in rows:
            sizes[s] += len(WORD.findall(t or ""))
        target = water_fill(sizes)
        got = mixing.copies(d).collect()
        assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), len(WORD.findall(t or ""))) for i, t, _ in rows)
        assert all(r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]] and 0 <= r["copies"] <= 2 for r in got)
        key = lambda x: sorted((str(r["doc_id"]), str(r["source"]), r["th"], r["copies"]) for r in x)
        assert key(got) == key(mixing.copies(d.repartition(7)).collect())
    taken = defaultdict(int)
    for r in mixing.copies(documents).collect():
        taken[r["source"]] += r["size"] * r["copies"]
    sizes = defaultdict(int)
    for r in documents.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    short = water_fill(sizes)
    assert abs(sum(taken.values()) / sum(short.values()) - 1) < 0.05
    assert mixing.copies(empty).count() == 0
    m = mixing.mix(corner)
    assert m.columns == corner.columns and m.count() == sum(r["copies"] for r in mixing.copies(corner).collect())


def test_rounding_keeps_expectations(documents):
    """Over many seeds the mean of a document's copies is its source's rate."""
    few = documents.where("doc_id < 24").cache()
    total = defaultdict(float)
    rate = {}
    for seed in range(30):
        for r in mixing.copies(few, seed=seed).collect():
            total[r["doc_id"]] += r["copies"] / 30
            rate[r["doc_id"]] = r["target"] / r["source_size"]
    assert np.mean([total[i] - rate[i] for i in rate]) == pytest.approx(0, abs=0.06)


# 10: n-gram scores


def brute_scores(rows):
    docs = [(i, WORD.findall(low(t or "")), zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2) for i, t in rows]
    uni, at = Counter(), defaultdict(list)
    seqs = [["<s>", *w, "</s>"] for _, w, _ in docs]
    for k, (_, w, held) in enumerate(docs):
        if not held:
            uni.update([*w, "</s>"])
            for p in range(len(w) + 1):
                at[seqs[k][p]].append((k, p))
    n, v = sum(uni.values()), len(uni)
    out = []
    for k, (i, w, held) in enumerate(docs):
        base = [math.log10((uni[x] + 1) / (n + v + 1)) for x in seqs[k][1:]]
        total = 0.0
        for p in range(len(w) + 1):
            found, length = at.get(seqs[k][p], []), 1
            while found and length <= p:
                more = [(j, r) for j, r in found if r - length >= 0 and seqs[j][r - length] == seqs[k][p - length]]
                if not more:
                    break
                found, length = more, length + 1
            seen = sum(seqs[j][r + 1] == seqs[k][p + 1] for j, r in found)
            total += base[p] if not found else math.log10(seen / (len(found) + 1)) if seen else base[p] - math.log10(len(found) + 1)
        out.append((str(i), held, len(w) + 1, sum(x in uni for x in seqs[k][1:]), n, round(sum(base), 5), round(total, 5)))
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_ngram_scores(spark, empty, monkeypatch, small):
    if small:
        for name, value in (("SHARD_TOKENS", 300), ("BLOCK_TOKENS", 40), ("FLUSH_TOKENS", 100), ("HOT_PARTS", 20), ("FAN", 2), ("MOST_SHARED", 0)):
            monkeypatch.setattr(ngram, name, value)
    rng = random.Random(8)
    rows = [(i, words_of(rng, rng.randint(0, 40))) for i in range(60)]
    rows += [(100 + i, rows[5][1] + " " + words_of(rng, i % 5)) for i in range(25)] + [(200, None), (201, ""), (None, "the of and"), (6, "Of the AND  the"), (6, "again the same id"), (6, "again the same id")]
    d = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, held int, id string").repartition(3)
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 5)) for r in ngram.score(d).collect())
    want = brute_scores(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], abs=2e-5) and [g[6] for g in got] == pytest.approx([w[6] for w in want], abs=2e-5)
    assert ngram.score(empty).count() == 0


def test_ngram_search_goes_to_holders_alone(spark, monkeypatch):
    """A line that all texts share is looked up in the one place that holds it, and not in every part of the corpus."""
    for name, value in (("SHARD_TOKENS", 100), ("BLOCK_TOKENS", 100)):
        monkeypatch.setattr(ngram, name, value)
    found, search = [], ngram.search_deep

    def noted(state, level, holders, folder):
        out = search(state, level, holders, folder).cache()
        found.append((holders, out.where("kind = 0").count(), out.where("kind = 1").count()))
        return out

    monkeypatch.setattr(ngram, "search_deep", noted)
    rng = random.Random(3)
    line = " ".join(f"shared{i}" for i in range(12))
    own = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(10))
    rows = [(i, f"{own()} {line} {own()}") for i in range(60)]
    got = sorted((str(r["doc_id"]), round(r["score"], 4)) for r in ngram.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect())
    assert [g[1] for g in got] == pytest.approx([w[6] for w in brute_scores(rows)], abs=2e-4)
    holders, blocks, reports = found[0]
    assert holders > 15 and blocks > 1 and 0 < reports <= 2 * blocks


def test_ngram_search_sends_a_holder_only_what_it_has(spark, monkeypatch):
    """Copied texts around a line that all share: the line goes to every holder, the rest of each text only to its own."""
    for name, value in (("SHARD_TOKENS", 150), ("BLOCK_TOKENS", 500), ("FAN", 7)):
        monkeypatch.setattr(ngram, name, value)
    sent, route = [], ngram.route_deep

    def noted(*args):
        out = route(*args).cache()
        sent.extend((r["holder"], int(ngram._unpack_runs(r["runs"])[2].sum())) for r in out.where("kind = 1").collect())
        return out

    monkeypatch.setattr(ngram, "route_deep", noted)
    rng = random.Random(5)
    line = " ".join(f"shared{i}" for i in range(8))
    own = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    held, train = ([i for i in range(300) if (zlib.crc32(str(i).encode()) % 7 == 2) == h] for h in (True, False))
    rows = []
    for g in range(20):
        text = f"{own()} {line} {own()}"
        rows += [(held[g], text), (train[2 * g], text), (train[2 * g + 1], text + " more")]
    got = sorted((str(r["doc_id"]), round(r["score"], 4)) for r in ngram.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect())
    assert [g[1] for g in got] == pytest.approx([w[6] for w in brute_scores(rows)], abs=2e-4)
    assert len({h for h, _ in sent}) > 10
    assert 20 * 88 <= sum(n for _, n in sent) <= 20 * (90 + 20 * 8)


def test_suffix_array():
    rng = np.random.default_rng(2)
    for n, v in ((0, 1), (1, 1), (50, 2), (400, 3), (300, 300)):
        t = rng.integers(0, v, n)
        assert ngram.suffix_array(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


# the pipeline


def test_pipeline(spark, tmp_path, corner, empty):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "near dedup", "mixing", "packing"]
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())
    for name, d in (("corner", corner), ("empty", empty)):
        folder = tmp_path / name
        d.write.parquet(str(folder / "documents.parquet"))
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(folder))
            if k < 4:
                assert out.columns == docs.columns
            out.write.parquet(str(folder / str(k)))
            docs = spark.read.parquet(str(folder / str(k)))
        assert (docs.count() == 0) == (name == "empty")
    assert Path(folder).exists()


def test_pipeline_brute_force(spark, documents):
    """Each stage's decisions over what the one before kept."""
    rng = random.Random(4)
    long_ = [r["text"] for r in documents.where("n_chars > 600").orderBy("doc_id").limit(25).collect()]
    texts = long_ + [long_[3], long_[3].replace(" ", "  "), long_[4] + " tail", "\n" + long_[5], "x9 " * 3, None, "", "qz#9 " * 50] + [" ".join(w for w in long_[6].split() if rng.random() > 0.01)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SMALL).cache())
    ids = [[r["doc_id"] for r in d.collect()] for d in out]
    texts = dict(enumerate(texts))
    judged = {r["doc_id"]: r["kept"] for r in language_id.identify_documents(docs).collect()}
    assert sorted(ids[1]) == sorted(i for i in ids[0] if judged[i]) and set(ids[1]) >= set(range(29)) and not {30, 31} & set(ids[1])
    assert sorted(ids[2]) == sorted(min(g) for g in brute_groups([(i, texts[i]) for i in ids[1]]).values())
    assert sorted(ids[3]) == sorted(min(map(int, c)) for c in brute_classes([(i, texts[i]) for i in ids[2]]))
    taken = {r["doc_id"]: r["copies"] for r in mixing.copies(out[3]).collect()}
    assert Counter(ids[4]) == Counter({i: n for i, n in taken.items() if n}) and max(taken.values()) <= 2
    by = defaultdict(list)
    for i in ids[4]:
        by[i].append(texts[i])
    check_packing(out[5].collect(), by)
