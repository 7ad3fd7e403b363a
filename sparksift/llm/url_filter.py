"""URL filters with DataFrame functions only.

Two kinds of rules judge a url. List rules name a host (with its subdomains) and
a path prefix; the longest that fits wins, of equal length the later by code
point. They are a table: each distinct url asks for its host's suffixes with the
first 0, 2, 4 or 8 characters of its path, and every rule is filed under the
longest of these that its own path has. Where none fits, pattern rules do the
work: regular expressions over the lower-cased url. Every match of a rule must
contain one token of each of its alternatives; the rule is filed under the
rarest token of each alternative, the tokens of a url fetch its candidate rules
through a join with that index, and only those run their expressions. Rules with
an alternative without such a token run on every url.

Rule tables of up to BROADCAST_ROWS are broadcast, larger ones are shuffled. All
work is done once per distinct url.

Cases: a url that is null or has no `://` has an empty host and path; list rules
may still not fit it, and it is allowed if no pattern matches; repeated rows and
repeated or null page ids each keep their row; an empty table gives an empty
result; a very long url is treated like others; other columns are ignored,
whatever their names. Empty rule lists are fine; rules that repeat are one.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from importlib.resources import files
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ascii_lower, cut, hot_join

ALNUM = set("abcdefghijklmnopqrstuvwxyz0123456789")
#: Lengths of the path beginnings that list rules are filed under.
PREFIXES = (0, 2, 4, 8)
#: Expressions of more alternatives than this have no index.
MOST_ALTERNATIVES = 256


@dataclass(frozen=True)
class ListRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """A regular expression over the lower-cased url; of several that match, the first of the list decides."""

    name: str
    verdict: str
    regex: str


LIST_RULES = (
    ListRule("allow", "org", "/"),
    ListRule("block", "example.org", "/es/"),
    ListRule("block", "example.org", "/en/1"),
    ListRule("allow", "com", "/fr/"),
    ListRule("block", "com", "/de/"),
)


def read_patterns(text: str) -> tuple[PatternRule, ...]:
    """Pattern rules of a text: name, verdict and expression a line, between tabs; lines that begin with # are comments."""
    rows = [line.split("\t", 2) for line in text.splitlines() if line.strip() and not line.startswith("#")]
    bad = [r for r in rows if len(r) < 3 or r[1] not in ("allow", "block")]
    if bad:
        raise ValueError(f"not a pattern rule: {bad[0]}")
    return tuple(PatternRule(*r) for r in rows)


def read_list(text: str) -> tuple[ListRule, ...]:
    """List rules of a text: `allow host/path` or `block host/path` a line; lines that begin with # are comments."""
    out = []
    for line in text.splitlines():
        if line.strip() and not line.startswith("#"):
            verdict, _, where = line.strip().partition(" ")
            host, slash, path = where.strip().partition("/")
            if verdict not in ("allow", "block") or not host:
                raise ValueError(f"not a list rule: {line!r}")
            out.append(ListRule(verdict, host.lower(), slash + path))
    return tuple(out)


PATTERN_RULES = read_patterns(files(__package__).joinpath("url_rules.tsv").read_text())


# Which tokens an expression needs: items are a character, EDGE (no letter or digit stands there) or ANY.
EDGE, ANY = "edge", "any"


class _Unknown(Exception):
    """Something that isn't read here."""


class _Reader:
    """Alternatives of an expression, each a list of items."""

    def __init__(self, regex: str):
        self.s, self.i = regex, 0

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        if self.i > len(self.s):
            raise _Unknown
        return self.s[self.i - 1]

    def alternatives(self) -> list[list[str]]:
        out = self.sequence()
        while self.peek() == "|":
            self.take()
            out = out + self.sequence()
        if len(out) > MOST_ALTERNATIVES:
            raise _Unknown
        return out

    def sequence(self) -> list[list[str]]:
        out: list[list[str]] = [[]]
        while self.peek() not in ("", "|", ")"):
            one = self.repeated(self.atom())
            if len(out) * len(one) > MOST_ALTERNATIVES:
                raise _Unknown
            out = [a + b for a, b in product(out, one)]
        return out

    def atom(self) -> list[list[str]]:
        c = self.take()
        if c == "(":
            if self.peek() == "?":
                self.take()
                if self.take() != ":":
                    raise _Unknown
            inner = self.alternatives()
            if self.take() != ")":
                raise _Unknown
            return inner
        if c == "[":
            return [[self.chars()]]
        if c == "\\":
            e = self.take()
            if e.isalnum():
                if e not in "dwsDWSb":
                    raise _Unknown
                return [[EDGE if e in "sWb" else ANY]]
            return [[EDGE]]
        if c in "^$":
            return [[EDGE]]
        if c == ".":
            return [[ANY]]
        if c in "*+?{":
            raise _Unknown
        return [[c if c in ALNUM else EDGE if ord(c) < 128 and not c.isalnum() else ANY]]

    def chars(self) -> str:
        """A class: EDGE if it holds no letter and no digit, its character if it has just one."""
        start = self.i
        if self.peek() in ("^", "]"):
            self.take()
        while self.peek() != "]":
            if self.take() == "\\":
                self.take()
        body = self.s[start : self.i]
        self.take()
        if body.startswith("^") or any(ord(c) > 127 for c in body):
            return ANY
        plain = body.replace("\\", "")
        return plain if plain in ALNUM else EDGE if not any(c.isalnum() for c in plain) and "-" not in plain[1:-1] else ANY

    def repeated(self, one: list[list[str]]) -> list[list[str]]:
        c = self.peek()
        if c not in ("*", "+", "?", "{") or not c:
            return one
        self.take()
        if c == "{":
            at = self.s.index("}", self.i) if "}" in self.s[self.i :] else -1
            if at < 0:
                raise _Unknown
            low = self.s[self.i : at].split(",")[0]
            self.i = at + 1
            c = "*" if low in ("", "0") else "+"
        if self.peek() in ("?", "+"):
            self.take()
        if c == "?":
            return [[], *one]
        edge = all(x == [EDGE] for x in one)
        return [[EDGE if edge else ANY]] if c == "+" else [[], [EDGE]] if edge else [[ANY]]


def literal_tokens(regex: str) -> list[list[str]]:
    """Per alternative, the tokens of [a-z0-9] that stand between other characters in whatever it matches; [] if some alternative has none."""
    try:
        reader = _Reader(regex.removeprefix("(?i)"))
        found = reader.alternatives()
        if reader.peek():
            raise _Unknown
    except _Unknown:
        return []
    out = set()
    for items in found:
        tokens, run, bounded = set(), "", False
        for x in [*items, ANY]:
            if x in ALNUM:
                run += x
                continue
            if run and bounded and x == EDGE:
                tokens.add(run)
            run, bounded = "", x == EDGE
        if not tokens:
            return []
        out.add(tuple(sorted(tokens)))
    return [list(x) for x in sorted(out)]


def parse(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _sized(table: DataFrame) -> DataFrame:
    """A table of rules, to be broadcast if it is small."""
    table = cut(table)
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def list_table(spark: SparkSession, rules: Iterable[ListRule] | DataFrame) -> DataFrame:
    """verdict, host, path of list rules."""
    return rules.select("verdict", "host", "path") if isinstance(rules, DataFrame) else spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")


def _list_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls(url, host, path) -> (url, fit: the rule that wins), of those that a rule fits."""
    filed = F.greatest(*[F.when(F.length("path") >= k, F.lit(k)).otherwise(0) for k in PREFIXES])
    index = rules.distinct().select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.substring("path", F.lit(1), filed).alias("r_key"), "verdict")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    asked = urls.select("url", "path", F.explode(suffixes).alias("suffix"))
    asked = asked.select("url", "path", "suffix", F.explode(F.array_distinct(F.array(*[F.substring("path", 1, k) for k in PREFIXES]))).alias("key"))
    hits = asked.join(_sized(index), F.expr("suffix = r_host AND key = r_key")).where(F.startswith("path", F.col("r_path")))
    text = F.concat("r_host", "r_path")
    return hits.groupBy("url").agg(F.max(F.struct(F.length(text).alias("n"), text.alias("rule"), "verdict")).alias("fit"))


def _pattern_rules(urls: DataFrame, rules: Iterable[PatternRule]) -> DataFrame:
    """urls(url, low) -> (url, p: the first rule that matches), of those that one matches."""
    spark = urls.sparkSession
    rules = list(rules)
    schema = "rank int, pattern string, p_verdict string, regex string"
    table = spark.createDataFrame([(i, r.name, r.verdict, r.regex) for i, r in enumerate(rules)], schema)
    needs = [(i, k, t) for i, r in enumerate(rules) for k, tokens in enumerate(literal_tokens(r.regex)) for t in tokens]
    tokens = _sized(spark.createDataFrame(needs, "rank int, branch int, token string"))
    said = urls.select("url", "low", F.explode(F.array_distinct(F.split("low", "[^a-z0-9]+"))).alias("token"))
    freq = said.join(tokens.select("token").distinct(), "token").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    rarest = tokens.join(freq, "token", "left").groupBy("rank", "branch").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")).alias("m"))
    index = _sized(rarest.select("rank", F.col("m.token").alias("token")).distinct().join(table, "rank"))
    best = F.struct("rank", "pattern", "p_verdict")
    hits = said.join(index, "token").where(F.expr("low rlike regex")).select("url", best.alias("p"))
    for i, r in enumerate(rules):
        if not literal_tokens(r.regex):
            hits = hits.unionByName(urls.where(F.col("low").rlike(r.regex)).select("url", F.struct(F.lit(i).alias("rank"), F.lit(r.name).alias("pattern"), F.lit(r.verdict).alias("p_verdict")).alias("p")))
    return hits.groupBy("url").agg(F.min("p").alias("p"))


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", list_rules: Iterable[ListRule] | DataFrame = LIST_RULES, pattern_rules: Iterable[PatternRule] = PATTERN_RULES, default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule (list rule or null), verdict, pattern (name of the pattern rule that decided, or null)."""
    base = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    host, path = parse(F.col("url"))
    urls = cut(base.groupBy("url").agg(F.count(F.lit(1)).alias("n")).select("url", "n", host.alias("host"), path.alias("path")))
    fits = cut(_list_rules(urls, list_table(pages.sparkSession, list_rules)))
    open_ = urls.join(fits.select("url"), "url", "left_anti").select("url", ascii_lower(F.col("url")).alias("low"))
    judged = urls.join(fits, "url", "left").join(_pattern_rules(open_, pattern_rules), "url", "left")
    judged = cut(judged.select("url", "n", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "p.p_verdict", F.lit(default)).alias("verdict"), F.col("p.pattern").alias("pattern")))
    out = hot_join(base, judged, ["url"], "n", judged.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "pattern")
