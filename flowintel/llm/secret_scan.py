"""Secret scan over a trigram inverted index, with DataFrame functions only.

Each rule's regex gives a Boolean query: an OR of clauses, each an AND of trigrams that every
match must hold, in lower case.  Postings (trigram, document) exist for the trigrams that
the queries name.  Intersecting them by clause gives candidate documents, which the regex then
verifies; a rule without mandatory trigrams scans every text.

Spans are [start, end) in code points, leftmost and non-overlapping per rule.  A match whose
value is too short is dropped and its characters are not searched again.

Null text counts as empty and has no spans.  A null id is a key like any other.  Rows with
the same id share their candidates and are verified one by one.  An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowintel.session import join_per_key

MASK = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    """`least` characters are needed in the given group (0: the whole match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES


def _runs(tokens) -> list[list[str]]:
    """Alternatives of a parsed regex; each is a list of literal runs, with a gap between neighbours."""
    ways: list[list[str]] = [[""]]
    for op, arg in tokens:
        name = str(op)
        if name == "LITERAL":
            step = [[chr(arg)]]
        elif name == "SUBPATTERN":
            step = _runs(arg[3])
        elif name == "BRANCH":
            step = [way for branch in arg[1] for way in _runs(branch)]
        elif name == "MAX_REPEAT" and arg[0] >= 1:
            step = [[*way, ""] for way in _runs(arg[2])]
        elif name == "MAX_REPEAT" and arg[1] == 1:
            step = [[""], *_runs(arg[2])]
        else:
            step = [["", ""]]
        ways = [[*left[:-1], left[-1] + right[0], *right[1:]] for left, right in product(ways, step)]
    return ways


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Clauses of mandatory lower-case trigrams; empty if some alternative has none."""
    ways = _runs(re._parser.parse(pattern))
    clauses = [frozenset(run[i : i + 3].lower() for run in way for i in range(len(run) - 2)) for way in ways]
    if not all(clauses):
        return []
    return sorted({c for c in clauses if not any(other < c for other in clauses)}, key=sorted)


def postings(docs: DataFrame, id_col: str, text_col: str, trigrams: list[str]) -> DataFrame:
    """(trigram, doc): the inverted index of these trigrams over all texts."""
    lowered = docs.select(F.col(id_col).alias("doc"), F.lower(F.col(text_col).cast("string")).alias("_low"))
    held = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return lowered.select("doc", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc, kinds): documents that satisfy the trigram query of at least one rule."""
    clauses = [(rule.kind, i, t, len(clause)) for rule in rules
               for i, clause in enumerate(trigram_query(rule.pattern)) for t in sorted(clause)]
    index = postings(docs, id_col, text_col, sorted({c[2] for c in clauses}))
    query = docs.sparkSession.createDataFrame(clauses, "kind string, clause int, trigram string, wanted int")
    met = (index.join(F.broadcast(query), "trigram").groupBy("doc", "kind", "clause", "wanted")
           .agg(F.count_distinct("trigram").alias("_n")).where("_n = wanted"))
    return met.groupBy("doc").agg(F.collect_set("kind").alias("kinds"))


def rule_spans(text: Column, rule: Rule, place: int) -> Column:
    """array<struct<start, place, kind, end>> of the rule's spans in a text."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)
    value = lambda x: F.regexp_extract(x, rule.pattern, rule.group) if rule.group else x
    span = "struct<start: bigint, place: int, kind: string, end: bigint>"
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{span}>").alias("out"))

    def step(state: Column, item: Column) -> Column:
        start = state["at"] + F.length(item["between"])
        end = start + F.length(item["found"])
        this = F.struct(start.cast("bigint").alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"),
                        end.cast("bigint").alias("end"))
        kept = F.when(F.length(value(item["found"])) >= rule.least, F.array(this)).otherwise(F.array().cast(f"array<{span}>"))
        return F.struct(end.cast("bigint").alias("at"), F.concat(state["out"], kept).alias("out"))

    pairs = F.arrays_zip(between.alias("between"), found.alias("found"))
    walked = F.aggregate(F.filter(pairs, lambda x: x["found"].isNotNull()), zero, step)["out"]
    return F.when(text.rlike(rule.pattern), walked).otherwise(F.array().cast(f"array<{span}>"))


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows with `_spans`, sorted by start, then by rule."""
    hits = candidates(docs, id_col, text_col, rules).select(F.col("doc").alias("_doc"), F.col("kinds").alias("_kinds"))
    joined = join_per_key(docs, hits, docs[id_col].eqNullSafe(F.col("_doc")))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    parts = []
    for place, rule in enumerate(rules):
        spans = rule_spans(text, rule, place)
        if trigram_query(rule.pattern):
            spans = F.when(F.array_contains("_kinds", rule.kind), spans)
        parts.append(F.coalesce(spans, F.array().cast("array<struct<start: bigint, place: int, kind: string, end: bigint>>")))
    return joined.withColumn("_spans", F.array_sort(F.concat(*parts))).drop("_doc", "_kinds")


def span_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, counts of the base kinds, digest of the base spans, and all spans as text."""
    found = with_spans(docs, id_col, text_col)
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("_spans", lambda s: s["place"] < len(BASE_RULES))
    return found.select(id_col, *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES],
                        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("_spans")).alias("spans"))


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows with every span (overlapping ones as one) replaced by a mask and the length column renewed."""
    found = with_spans(docs, id_col, text_col)
    text = F.col(text_col)
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        kept = F.substring(text, (done["at"] + 1).cast("int"), F.greatest(s["start"] - done["at"], F.lit(0)).cast("int"))
        mask = F.when(s["start"] >= done["at"], F.lit(MASK)).otherwise("")
        return F.struct(F.greatest(s["end"], done["at"]).alias("at"), F.concat(done["out"], kept, mask).alias("out"))

    walked = F.aggregate("_spans", state, step)
    rest = F.substring(text, (walked["at"] + 1).cast("int"), F.length(text))
    masked = F.when(F.size("_spans") > 0, F.concat(walked["out"], rest)).otherwise(text)
    changed = found.withColumn(text_col, masked)
    if chars_col in docs.columns:
        renewed = F.when(F.size("_spans") > 0, F.length(text_col).cast(docs.schema[chars_col].dataType))
        changed = changed.withColumn(chars_col, renewed.otherwise(F.col(chars_col)))
    return changed.select(docs.columns)
