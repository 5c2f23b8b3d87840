"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule is a regular expression. ``trigram_clauses`` derives from its syntax tree what any match must
hold: a disjunction of sets of trigrams (in lower case, so one index serves every rule). ``postings``
is the inverted index, rows of (trigram, doc_id), restricted to the trigrams that some rule asks for.
``candidates`` intersects the postings of each set and unites the sets of a rule. Only candidates are
verified by the expression itself; a rule without mandatory trigrams scans every text.

A rule finds leftmost non-overlapping matches; those whose checked group is shorter than the rule's
minimum are dropped after matching, so they still use up their text. Spans count code points, the end
is exclusive. They are found by splitting the text at the matches and adding up lengths.

Scale: the index holds ids, never texts. Postings are reduced per document and clause by a map-side
``bit_or``; the verdict joins the texts on the id, by broadcast where the candidates are few. No
document's matches meet those of another.

Nulls: a null text is empty. Rows with a null id share their candidates, rows with the same id likewise;
each row is still verified by its own text. Extra columns stay out; empty input gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_STRINGS = 64
MOST_CLAUSES = 128


@dataclass(frozen=True)
class Rule:
    """A kind of secret; ``least`` is the smallest length of ``group`` (0: the whole match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base rules of the query's contract.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("code_host", r"gh[opsu]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abps]-[A-Za-z0-9-]+", 0, 20),
    Rule("payment", r"sk_live_[A-Za-z0-9]+", 0, 24),
    Rule("bearer", r"(?i)bearer\x20+[A-Za-z0-9._~+/-]+", 0, 27),
)
RULES = (*BASE_RULES, *MORE_RULES)

Clauses = list[frozenset[str]]


def trigram_clauses(pattern: str) -> Clauses:
    """Sets of trigrams of which every match holds at least one whole set; [empty set] if nothing is mandatory."""
    strings, clauses = _sequence(_parser.parse(pattern))
    return _both(clauses, _of_strings(strings))


def _of_strings(strings: set[str]) -> Clauses:
    return _fewest([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings])


def _fewest(clauses: Clauses) -> Clauses:
    """Without sets that hold another set: the smaller one already admits the match."""
    kept: Clauses = []
    for c in sorted(set(clauses), key=lambda c: (len(c), sorted(c))):
        if not any(k <= c for k in kept):
            kept.append(c)
    return kept


def _both(a: Clauses, b: Clauses) -> Clauses:
    """Conjunction; where it would grow too large, one side alone, which admits more."""
    return _fewest([x | y for x, y in product(a, b)]) if len(a) * len(b) <= MOST_CLAUSES else min(a, b, key=len)


def _sequence(items) -> tuple[set[str], Clauses]:
    """(strings that the match's open end may be, clauses of what lies before it)."""
    strings, clauses = {""}, [frozenset()]

    def follow(more: set[str] | None, inner: Clauses) -> None:
        nonlocal strings, clauses
        joined = {a + b for a in strings for b in more} if more is not None and len(strings) * len(more) <= MOST_STRINGS else None
        if joined is None or inner != [frozenset()]:
            clauses = _both(_both(clauses, _of_strings(strings)), inner)
            strings = more if more is not None else {""}
        else:
            strings = joined

    for kind, value in items:
        if kind is sre.LITERAL:
            follow({chr(value).lower()}, [frozenset()])
        elif kind is sre.IN:
            follow(_members(value), [frozenset()])
        elif kind is sre.SUBPATTERN:
            follow(*_sequence(value[-1]))
        elif kind is sre.BRANCH:
            parts = [_sequence(part) for part in value[1]]
            if all(c == [frozenset()] for _, c in parts):
                follow(set().union(*(s for s, _ in parts)), [frozenset()])
            else:
                follow(None, _fewest([c for s, inner in parts for c in _both(inner, _of_strings(s))]))
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = value
            found, needs = _sequence(inner)
            if (least, most) == (0, 1) and needs == [frozenset()]:
                follow({"", *found}, [frozenset()])
            elif least == most == 1:
                follow(found, needs)
            else:
                for _ in range(min(least, 8) if needs == [frozenset()] and least == most else min(least, 1)):
                    follow(found, needs)
                if least != most or least > 8:
                    follow(None, [frozenset()])
        elif kind is not sre.AT:
            follow(None, [frozenset()])
    return strings, clauses


def _members(parts) -> set[str] | None:
    """The characters of a small class, or None."""
    found: set[str] = set()
    for kind, value in parts:
        if kind is sre.LITERAL:
            found.add(chr(value).lower())
        elif kind is sre.RANGE and value[1] - value[0] < 8:
            found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return found if len(found) <= 8 else None


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The index: (trigram number in ``trigrams``, doc_id) for every text that holds it in any case."""
    lowered = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("_text"))
    held = F.array_compact(F.array(*[F.when(F.contains("_text", F.lit(g)), F.lit(i)) for i, g in enumerate(trigrams)]))
    return lowered.select("doc_id", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, trigrams: list[str], clauses: list[tuple[int, frozenset[str]]]) -> DataFrame:
    """(doc_id, rules): the numbers of the rules of which the document holds a whole set."""
    uses: list[list[tuple[int, int]]] = [[] for _ in trigrams]
    for number, (_, needs) in enumerate(clauses):
        for bit, gram in enumerate(sorted(needs)):
            uses[trigrams.index(gram)].append((number, 1 << bit))
    table = F.array(*[F.array(*[F.struct(F.lit(n).alias("clause"), F.lit(b).cast("long").alias("bit")) for n, b in use]) for use in uses])
    seen = index.select("doc_id", F.explode(F.get(table, F.col("trigram"))).alias("use"))
    met = seen.groupBy("doc_id", F.col("use.clause").alias("clause")).agg(F.bit_or("use.bit").alias("bits"))
    full = F.array(*[F.lit((1 << len(needs)) - 1).cast("long") for _, needs in clauses])
    rule = F.array(*[F.lit(number) for number, _ in clauses])
    whole = met.where(F.col("bits") == F.get(full, F.col("clause")))
    return whole.groupBy("doc_id").agg(F.collect_set(F.get(rule, F.col("clause"))).alias("rules"))


def spans(rule: Rule, number: int, text: Column) -> Column:
    """Matches of one rule as structs (start, rule, end), by start."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    held = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    parts = F.zip_with(F.zip_with(gaps, whole, lambda g, w: F.struct(g.alias("gap"), F.length(w).alias("wide"))), held, lambda p, h: F.struct(p["gap"].alias("gap"), p["wide"].alias("wide"), F.length(h).alias("held")))
    none = F.array().cast("array<struct<start:int,rule:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + part["gap"]
        end = begin + part["wide"]
        one = F.array(F.struct(begin.alias("start"), F.lit(number).alias("rule"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(part["held"] >= rule.least, F.concat(state["found"], one)).otherwise(state["found"]).alias("found"))

    return F.aggregate(F.filter(parts, lambda p: p["wide"].isNotNull()), start, step, lambda s: s["found"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and ``found``: all matches as structs (start, rule number, end), by start, then rule."""
    needs = {i: trigram_clauses(r.pattern) for i, r in enumerate(rules)}
    indexed = [(i, c) for i, clauses in needs.items() if frozenset() not in clauses for c in clauses if len(c) <= 62]
    full = {i for i, clauses in needs.items() if frozenset() in clauses or any(len(c) > 62 for c in clauses)}
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if indexed:
        trigrams = sorted({g for _, c in indexed for g in c})
        likely = candidates(postings(docs, trigrams), trigrams, indexed).withColumnRenamed("doc_id", "_id")
        rows = rows.join(likely, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    none = F.array().cast("array<struct<start:int,rule:int,end:int>>")
    parts = []
    for i, rule in enumerate(rules):
        mine = spans(rule, i, F.col("text"))
        parts.append(mine if i in full else F.when(F.array_contains("rules", i), mine).otherwise(none))
    return rows.select("doc_id", F.array_sort(F.concat(*parts)).alias("found"))


def listing(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
