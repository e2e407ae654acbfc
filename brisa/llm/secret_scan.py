"""Secret scans over a trigram index, with DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: literal
runs of the expression become clauses, a clause is an OR over the run's spellings, and
each spelling an AND of its trigrams.  Postings (trigram, document) are kept for the
trigrams that some rule asks for; intersecting them gives each rule's candidates, and
only those are verified with the expression.  A rule without mandatory trigrams
scans every text.  Trigrams are taken of the text with A-Z lower-cased.

A span is found with its offset by one expression: a lazy gap before the match, and an
end-of-text alternative so that the last gap is matched once.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from functools import reduce
from itertools import product
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import stage, text_or_empty


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # groups: none, or one that holds the value
    least: int = 0  # least length of the value (of the match, without a group)
    base: bool = False

    @property
    def grouped(self) -> bool:
        return parser.parse(self.pattern).state.groups > 1


#: base kinds first, in their listed order
RULES = (
    Rule("assign", r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, True),
    Rule("hex", r"[0-9a-f]+", 24, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: spellings of one literal run that a query lists at most; longer lists end the run
SPELLINGS = 64


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """AND of clauses, each an OR of trigram sets; no clause: every text is a candidate."""
    clauses: list[list[frozenset[str]]] = []

    def end(run: set[str]) -> set[str]:
        if run and all(len(s) >= 3 for s in run):
            sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in run}
            clauses.append(sorted((s for s in sets if not any(t < s for t in sets)), key=sorted))
        return {""}

    def spellings(items) -> set[str] | None:
        """All strings of a sub-expression (lower case), or None if they are too many."""
        out = {""}
        for op, arg in items:
            if op is sre.LITERAL:
                own = {chr(arg)}
            elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
                own = {chr(a) for _, a in arg}
            elif op is sre.SUBPATTERN:
                own = spellings(arg[3])
            elif op is sre.BRANCH:
                parts = [spellings(b) for b in arg[1]]
                own = None if None in parts else set().union(*parts)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] <= 3:
                one = spellings(arg[2])
                own = None if one is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(one, repeat=n)}
            else:
                own = None
            if own is None or len(out) * len(own) > SPELLINGS:
                return None
            out = {a + b.lower() for a in out for b in own}
        return out

    def walk(items, run: set[str]) -> set[str]:
        for item in items:
            own = spellings([item])
            if own is not None:
                if len(run) * len(own) > SPELLINGS:
                    run = end(run)
                run = {a + b for a in run for b in own}
            elif item[0] is sre.SUBPATTERN:
                run = walk(item[1][3], run)
            else:
                run = end(run)
                if item[0] in (sre.MAX_REPEAT, sre.MIN_REPEAT) and item[1][0] >= 1:
                    end(walk(item[1][2], {""}))
        return run

    end(walk(parser.parse(pattern), {""}))
    return clauses


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id) for the asked trigrams that occur in each text (doc_id, text)."""
    folded = F.lower(text_or_empty())  # literal runs are ASCII: other letters' case does not matter
    present = [F.when(F.contains(F.col("folded"), F.lit(t)), F.lit(t)) for t in trigrams]
    return (docs.select("doc_id", folded.alias("folded"))
            .select("doc_id", F.explode(F.array_compact(F.array(*present))).alias("trigram")).distinct())


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id and, for each rule with a query, whether the document meets it."""
    have = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("have"))  # bounded by the rules' trigrams

    def meets(query) -> Column:
        every = lambda s: reduce(and_, [F.array_contains("have", t) for t in sorted(s)])
        return reduce(and_, [reduce(or_, [every(s) for s in clause]) for clause in query])

    wanted = [(r, q) for r in rules if (q := trigram_query(r.pattern))]
    met = have.select("doc_id", *(meets(q).alias(f"c_{r.kind}") for r, q in wanted))
    return met.filter(reduce(or_, [F.col(f"c_{r.kind}") for r, _ in wanted]))


def _spans(rule: Rule, order: int) -> Column:
    """Spans of a rule in `text`: array of (start, rank, end, kind), code points, end exclusive."""
    whole = rf"([\s\S]*?)({rule.pattern}|\z)"
    found = [F.regexp_extract_all("text", F.lit(whole), F.lit(1)).alias("gap"), F.regexp_extract_all("text", F.lit(whole), F.lit(2)).alias("hit")]
    if rule.grouped:
        found.append(F.regexp_extract_all("text", F.lit(whole), F.lit(3)).alias("value"))
    kind = "array<struct<start:int,rank:int,end:int,kind:string>>"

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(order).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        value = x["value"] if rule.grouped else x["hit"]
        keep = (F.length(x["hit"]) > 0) & (F.length(value) >= rule.least)
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.arrays_zip(*found), F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (array of start, rank, end, kind, by start and rank) of every row of ``docs`` (doc_id, text).

    Null texts are empty.  Rows that share a doc_id share candidates, each is verified on
    its own text; null ids are an id of their own.  Other columns are ignored.
    """
    rows = docs.select("doc_id", text_or_empty().cast("string").alias("text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    trigrams = sorted({t for q in queries.values() for clause in q for s in clause for t in s})
    if trigrams:
        index = stage(postings(rows, trigrams), "secret-postings")
        met = candidates(index, rules).withColumnRenamed("doc_id", "id")
        rows = rows.join(met, rows["doc_id"].eqNullSafe(met["id"]), "left").drop("id")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    found = []
    for k, rule in enumerate(rules):
        if queries[rule.kind]:
            wanted = F.coalesce(F.col(f"c_{rule.kind}"), F.lit(False))
        else:  # no mandatory trigram: every text, by a plain search first
            wanted = F.col("text").rlike(f"(?:{rule.pattern[:-1]}{{{rule.least},}})" if rule.pattern.endswith("]+") else rule.pattern)
        found.append(F.when(wanted, _spans(rule, k)).otherwise(none))
    return rows.select("doc_id", F.array_sort(F.concat(*found)).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
