"""Secret scans by a trigram inverted index. DataFrame functions only.

Each rule's regular expression gives a Boolean query over trigrams: every literal stretch of the expression must occur, as one of its spellings. The trigrams the rules ask for are
posted (trigram, document) over the lower-case texts; joining postings with the queries and counting trigrams per spelling intersects them. The candidates meet
their texts again in one join by key and are verified by the regular expression. Rules without a mandatory trigram scan every text in that same pass.

The key of a document is a 64-bit hash of its id and text, so rows without an id work, and a clash only makes a candidate more.

Defined cases: null text counts as empty. Repeated rows are scanned each. Null ids stay null. An empty table gives no rows. Extra columns stay in `redact`. Positions are code points,
ends exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre  # the standard library's own parse of an expression
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.tables import set_aside, stored


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str     # in the part of the syntax that Python and Java read alike
    group: int = 0   # whose length counts
    least: int = 1
    base: bool = False


# A private key runs to its END line if no other line of five dashes comes before it. Without one, to the end of the base64 that follows: header lines, runs of 16 signs or more after
# blanks or line breaks (also spelled with a backslash), and the short last line. All loops are possessive, so long texts cost neither stack nor quadratic time.
_KEY_BODY = r"""(?:[^-]++|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----"""
_KEY_GAP = r"""(?:[ \t\r\n>"'+,]|\\[nrt])++"""
_KEY_HEADER = _KEY_GAP + r"""(?:(?:Proc-Type|DEK-Info):[ \t]*+[^ \t\r\n\\]*+|[A-Z][A-Za-z0-9-]*+:[^\r\n]*+(?=[\r\n]))"""
_KEY_LAST = rf"""[ \t>"'+,]*+(?:\r?\n|\r|\\n|\\r\\n)[ \t>"'+,]*+[A-Za-z0-9+/]++={{0,2}}+(?=[ \t]*+(?:[\r\n"'\\]|$))|{_KEY_GAP}[A-Za-z0-9+/]++={{1,2}}+"""
_KEY_OPEN = rf"""(?:{_KEY_HEADER})*+(?:{_KEY_GAP}[A-Za-z0-9+/]{{16,}}+={{0,2}}+)++(?:{_KEY_LAST})?+"""

# `{14,}` and `{16,}` say the same as `+` and a least length: such runs are matched whole either way.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("code_host", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_KEY_BODY}|{_KEY_OPEN})?"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)
MOST_SPELLINGS = 64
MARK = "[SECRET]"


def _literals(tree) -> list[list[str]]:
    """Stretches of an expression that must occur, each as a list of lower-case spellings."""
    found: list[list[str]] = []
    now = [""]

    def end() -> None:
        nonlocal now
        found.append(now)
        now = [""]

    def then(choices: list[str]) -> None:
        nonlocal now
        if len(now) * len(choices) > MOST_SPELLINGS:
            end()
        now = [a + b for a in now for b in choices]

    def spellings(items) -> list[str] | None:
        """All texts of a part, if they are few and it is made of literals only."""
        out = [""]
        for op, arg in items:
            part = one(op, arg)
            if part is None or len(out) * len(part) > MOST_SPELLINGS:
                return None
            out = [a + b for a in out for b in part]
        return out

    def one(op, arg) -> list[str] | None:
        if op is sre.LITERAL:
            return [chr(arg).lower()]
        if op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            return [chr(a).lower() for _, a in arg]
        if op is sre.SUBPATTERN:
            return spellings(arg[3])
        if op is sre.BRANCH:
            parts = [spellings(b) for b in arg[1]]
            return None if None in parts else [s for p in parts for s in p]
        if op is sre.MAX_REPEAT and arg[0] == arg[1] and arg[1] <= 8:
            return spellings(list(arg[2]) * arg[0])
        if op is sre.MAX_REPEAT and (arg[0], arg[1]) == (0, 1):
            part = spellings(arg[2])
            return None if part is None else ["", *part]
        return None

    def walk(items) -> None:
        for op, arg in items:
            part = one(op, arg)
            if part is not None:
                then(part)
            elif op is sre.SUBPATTERN:
                walk(arg[3])
            else:
                end()
                if op is sre.MAX_REPEAT and arg[0] > 0:
                    walk(arg[2])
                    end()
    walk(tree)
    end()
    return found


def trigram_query(pattern: str) -> list[list[set[str]]]:
    """All of these must hold; each is a list of spellings, of which one must have all its trigrams. Empty: nothing is mandatory."""
    grams = lambda s: {s[i:i + 3] for i in range(len(s) - 2)}
    stretches = [[grams(s) for s in dict.fromkeys(choices)] for choices in _literals(parser.parse(pattern))]
    return [s for s in stretches if all(s)]


def _query_rows(rules: tuple[Rule, ...]) -> tuple[list[tuple], list[tuple]]:
    rows, needs = [], []
    for rule in rules:
        query = trigram_query(rule.pattern)
        if query:
            needs.append((rule.kind, len(query)))
        rows += [(t, rule.kind, c, a, len(grams)) for c, choices in enumerate(query) for a, grams in enumerate(choices) for t in sorted(grams)]
    return rows, needs


def _literal_rows(like: DataFrame, rows: list[tuple], *names: str) -> DataFrame:
    """A small table of literals, made in the plan itself."""
    structs = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row))) for row in rows))
    return like.sparkSession.range(1).select(F.inline(structs))


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The index: trigram, secret_key. Only trigrams that some rule asks for."""
    wanted = sorted({r[0] for r in _query_rows(rules)[0]})
    low = docs.select(_key().alias("secret_key"), F.lower("text").alias("low"))
    found = F.filter(F.array(*map(F.lit, wanted)), lambda t: F.contains(F.col("low"), t))
    return low.select(F.explode(found).alias("trigram"), "secret_key")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """secret_key and the rules whose trigram queries it meets."""
    rows, needs = _query_rows(rules)
    asked = F.broadcast(_literal_rows(index, rows, "trigram", "kind", "stretch", "spelling", "need"))  # the rules' own size
    needed = F.broadcast(_literal_rows(index, needs, "kind", "stretches"))
    met = index.distinct().join(asked, "trigram").groupBy("secret_key", "kind", "stretch", "spelling", "need").count().filter("count = need")
    both = met.groupBy("secret_key", "kind").agg(F.count_distinct("stretch").alias("got")).join(needed, "kind").filter("got = stretches")
    return both.groupBy("secret_key").agg(F.collect_set("kind").alias("secret_rules"))  # at most all rules


def _spans(rule: Rule, order: int) -> Column:
    """Matches of one rule in `text`: gaps and matches alternate, so their lengths give the places."""
    pattern = F.lit(rule.pattern)
    gaps = F.split("text", rule.pattern, -1)
    whole, part = F.regexp_extract_all("text", pattern, F.lit(0)), F.regexp_extract_all("text", pattern, F.lit(rule.group))
    lens = F.transform(F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), part.alias("part")), lambda z: F.struct(
        F.length(z["gap"]).alias("gap"), F.coalesce(F.length(z["whole"]), F.lit(0)).alias("len"), F.coalesce(F.length(z["part"]), F.lit(0)).alias("part")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,ord:int,kind:string,stop:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["gap"]
        one = F.struct(at.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), (at + x["len"]).alias("stop"))
        return F.struct((at + x["len"]).alias("at"), F.when(x["part"] >= rule.least, F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(lens, start, step, lambda acc: acc["out"])
    none = F.array().cast("array<struct<start:int,ord:int,kind:string,stop:int>>")
    may = F.col("text").rlike(rule.pattern)
    if trigram_query(rule.pattern):
        may = F.array_contains("secret_rules", rule.kind) & may
    return F.when(may, found).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns and secret_spans, sorted: start, ord (the rule's place), kind, stop. Input columns that begin with `secret_` are replaced."""
    docs = docs.drop(*(c for c in docs.columns if c.lower().startswith("secret_")))
    names = docs.columns
    index = stored(postings(docs.select("doc_id", "text"), rules).sortWithinPartitions("trigram"), "secret-postings")
    hits = candidates(index, rules)
    rows = docs.withColumn("secret_key", _key())
    rows = rows.join(hits, "secret_key", "left").withColumns({"secret_text": F.col("text"), "text": F.coalesce("text", F.lit("")), "secret_rules": F.coalesce("secret_rules", F.array().cast("array<string>"))})
    spans = F.array_sort(F.flatten(F.array(*(_spans(r, k) for k, r in enumerate(rules)))))
    return rows.withColumn("secret_spans", spans).select(*(F.col("secret_text").alias("text") if n == "text" else F.col(f"`{n}`") for n in names), "secret_spans")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns of `docs`, with a mark in place of every secret."""
    text = F.col("text")

    def step(acc: Column, x: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(MARK))
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), F.when(x["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("secret_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    safe, restored = set_aside(docs, "secret_")
    return restored(scan(safe, rules).withColumn("text", F.when(F.size("secret_spans") > 0, clean).otherwise(text)))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def compiled(rules: tuple[Rule, ...] = RULES) -> dict[str, re.Pattern]:
    return {r.kind: re.compile(r.pattern) for r in rules}
