"""Personal data by candidate gradient boosting, in DataFrame expressions alone.

Base. Four patterns (email, ip, card, phone) give leftmost matches; those that
fail their check are dropped. Positions come from the pieces between matches.

Candidates. A wider generator for each kind proposes more spans, which may
overlap: card numbers and phones that stand beside other digits (where the base
pattern runs on and fails), grouped with other marks, or without a country code;
addresses with [at] and [dot]; spelled dots of IPs. A candidate's features are bits
of its format (usual length, one kind of mark between groups) and context (letters
or digits beside it, words that announce such data). None of them says whether the
base pattern matches.

Boosting. Base spans are positives, candidates that fail their kind's check (check
digit, octets, number of digits, the last part of an address) are negatives, and all
others are left out: what the base patterns miss doesn't count as wrong, however
often it occurs. The corpus reduces to counts for each kind and feature code, at most
4 * 64 rows, from which the driver boosts depth-two trees by Newton steps; the trees
become a SQL expression over the code. A kind's threshold is the lowest score from
which on each level by itself holds 90 % positives. Candidates from there on that pass
their check are added, unless they overlap a base span of their kind.

Edge cases. Null text counts as empty: no spans, the digest of an empty string.
Null doc_id is kept. Repeated rows give repeated results. Empty table: no rows,
no trees. Other columns are ignored by find_pii() and kept by redact().
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.llm.shared import materialize

KINDS = ("email", "ip", "card", "phone")
# Possessive and guarded forms of the base patterns: the same matches, found without backtracking.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++\x20?(?:@|[\[({{]at[\])}}])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[({{]dot[\])}}])\x20?[A-Za-z0-9-]++)+",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\[?\(?\.\)?\]?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{12,19}|[0-9]{4}(?:[\x20._/-][0-9]{4}){2}[\x20._/-][0-9]{1,7}|[0-9]{4}[\x20._/-][0-9]{6}[\x20._/-][0-9]{5})(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[\x20.-]?)?(?<![0-9])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
USUAL = {"email": r"(?s).{8,64}", "ip": r"(?s).{7,15}", "card": r"(?:[^0-9]*[0-9]){15,16}[^0-9]*", "phone": r"\+?(?:[^0-9]*[0-9]){10,13}[^0-9]*"}
# one kind of mark between groups
EVEN = {
    "email": r"[^\x20]+",
    "ip": r"[0-9]+([^0-9]+)[0-9]+(?:\1[0-9]+){2}",
    "card": r"[0-9]+(?:([^0-9])[0-9]+(?:\1[0-9]+)*)?",
    "phone": r"[^\x20.-]*(?:([\x20.-])[^\x20.-]+(?:\1[^\x20.-]+)*)?",
}
CONTEXT = {"email": "mail|contact|write to", "ip": r"\bip\b|host|server|address", "card": "card|visa|credit|account", "phone": "phone|tel|call|mobile|fax"}
_OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:[^0-9]+0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
_TOP_LEVEL = r"(?:\.|[\[({]dot[\])}]\x20?)[A-Za-z]{2,24}$"
BITS = 6


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    doubled = lambda v: F.when(v > 4, v * 2 - 9).otherwise(v * 2)
    points = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 1, doubled(value(i))).otherwise(value(i)))
    return F.aggregate(points, F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    """The kind's check of a match."""
    if kind == "ip":
        return F.rlike(match, F.lit(_OCTETS))
    if kind == "email":
        return F.lit(True)
    n = F.length(_digits(match))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(12, 19), _luhn(_digits(match))).otherwise(F.lit(False))


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of all matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda s: F.length(s))
    steps = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")
    walk = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + F.length(s["m"])).alias("at"),
            F.array_append(acc["out"], F.struct((acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + F.length(s["m"])).alias("end"), s["m"].alias("match"))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.size(found) > 0, walk).otherwise(empty)


def _base_spans(number: int, kind: str) -> Column:
    good = F.filter(f"_m_{kind}", lambda m: _passes(kind, m["match"]))
    return F.transform(good, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(number).alias("kind")))


def _candidates(number: int, kind: str, text: Column) -> Column:
    """The kind's candidates with their feature codes."""

    def beside(at: Column) -> Column:
        return F.rlike(F.substring(text, at, F.lit(1)), F.lit(r"[\p{L}_=\"']"))

    def candidate(m: Column) -> Column:
        tests = [
            F.rlike(m["match"], F.lit(f"^(?:{USUAL[kind]})$")),
            F.rlike(m["match"], F.lit(f"^(?:{EVEN[kind]})$")),
            F.when(m["start"] > 0, beside(m["start"])).otherwise(F.lit(False)),
            beside(m["end"] + 1),
            F.rlike(F.lower(F.substring(text, F.greatest(F.lit(1), m["start"] - 23), F.least(F.lit(24), m["start"]))), F.lit(CONTEXT[kind])),
            F.rlike(F.substring(text, F.greatest(F.lit(1), m["start"] - 1), F.least(F.lit(2), m["start"])), F.lit(r"[0-9][\x20.,/-]?$"))
            | F.rlike(F.substring(text, m["end"] + 1, F.lit(2)), F.lit(r"^[\x20.,/-]?[0-9]")),
        ]
        good = F.rlike(m["match"], F.lit(_TOP_LEVEL)) if kind == "email" else _passes(kind, m["match"])
        code = sum((F.when(x, F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(tests)), F.lit(0))
        is_base = F.exists("_base", lambda b: (b["kind"] == number) & (b["start"] == m["start"]) & (b["end"] == m["end"]))
        clash = F.exists("_base", lambda b: (b["kind"] == number) & (b["start"] < m["end"]) & (b["end"] > m["start"]))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(number).alias("kind"), is_base.alias("base"), clash.alias("clash"), good.alias("good"), code.alias("code"))

    return F.transform(f"_w_{kind}", candidate)


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _base, its base spans, and _wide, the generators' candidates:
    arrays of (start, end, kind), _wide also with base (it is a base span), clash (it
    overlaps one), good (it passes its check) and code."""
    t = F.col("_pii_text")
    marked = {"email": r"[@\[({]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
    # a text without digits or such marks has no span: the patterns then see null
    out = docs.withColumn("_pii_text", F.when(F.rlike(F.col(text), F.lit(r"[0-9@]|[\[({]at[\])}]")), F.col(text)))
    out = out.withColumns({f"_m_{k}": F.when(F.rlike(t, F.lit(marked[k])), _matches(t, BASE[k])) for k in KINDS} | {f"_w_{k}": F.when(F.rlike(t, F.lit(marked[k])), _matches(t, WIDE[k])) for k in KINDS})
    none = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    out = out.withColumn("_base", F.concat(*[F.coalesce(_base_spans(n, k), none) for n, k in enumerate(KINDS)]))
    none = F.array().cast("array<struct<start:int,end:int,kind:int,base:boolean,clash:boolean,good:boolean,code:int>>")
    out = out.withColumn("_wide", F.concat(*[F.coalesce(_candidates(n, k, t), none) for n, k in enumerate(KINDS)]))
    return out.drop("_pii_text", *[f"_{c}_{k}" for c in "mw" for k in KINDS])


@dataclass(frozen=True)
class Boosted:
    """One kind's trees over feature codes: (bit, bit if set, bit if not, four leaves)."""

    prior: float
    trees: tuple[tuple[int, int, int, tuple[float, float, float, float]], ...]
    threshold: float

    def score(self, code: Column) -> Column:
        has = lambda bit: F.getbit(code, F.lit(bit)) == 1
        total = F.lit(self.prior)
        for bit, yes, no, leaf in self.trees:
            total = total + F.when(has(bit), F.when(has(yes), leaf[0]).otherwise(leaf[1])).otherwise(F.when(has(no), leaf[2]).otherwise(leaf[3]))
        return 1 / (1 + F.exp(-total))


def boost(counts: list[tuple[int, int, int]], rounds: int = 24, rate: float = 0.4, ridge: float = 1.0, precision: float = 0.9) -> Boosted:
    """Trees from rows (code, labelled candidates, positives)."""
    if not sum(p for _, _, p in counts):
        return Boosted(-20.0, (), 0.5)
    code, n, pos = (np.array(c, np.float64) for c in zip(*sorted(counts), strict=True))
    bits = (code.astype(np.int64)[:, None] >> np.arange(BITS)) & 1 == 1
    prior = log((pos.sum() + 1) / (n.sum() - pos.sum() + 1))
    f, trees = np.full(len(code), prior), []

    def gain(g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> float:
        return float(g[rows].sum() ** 2 / (h[rows].sum() + ridge))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = pos - n * p, n * p * (1 - p)

        def split(rows: np.ndarray) -> tuple[float, int]:
            return max((gain(g, h, rows & bits[:, b]) + gain(g, h, rows & ~bits[:, b]), -b) for b in range(BITS))

        best = max((split(bits[:, b])[0] + split(~bits[:, b])[0], -b) for b in range(BITS))
        bit = -best[1]
        yes, no = -split(bits[:, bit])[1], -split(~bits[:, bit])[1]
        parts = [bits[:, bit] & bits[:, yes], bits[:, bit] & ~bits[:, yes], ~bits[:, bit] & bits[:, no], ~bits[:, bit] & ~bits[:, no]]
        leaf = tuple(float(rate * g[r].sum() / (h[r].sum() + ridge)) for r in parts)
        for r, v in zip(parts, leaf, strict=True):
            f[r] += v
        trees.append((bit, yes, no, leaf))
    scores, threshold = 1 / (1 + np.exp(-f)), 1.1
    for s in sorted(set(scores), reverse=True):
        same = scores == s
        if pos[same].sum() < precision * n[same].sum():
            break
        threshold = float(s)
    return Boosted(prior, tuple(trees), threshold - 1e-9)


def train(candidates: DataFrame) -> list[Boosted]:
    """A model for each kind from rows with _wide: all labelled candidates count, as sums for each code."""
    # outer: else Spark filters on the array's size, and computes the array for that once more
    each = candidates.select(F.explode_outer("_wide").alias("c")).where("c.base or not c.good").groupBy("c.kind", "c.code").agg(F.count("*").alias("n"), F.count_if("c.base").alias("pos")).collect()
    return [boost([(r["code"], r["n"], r["pos"]) for r in each if r["kind"] == k]) for k in range(len(KINDS))]


def _all_spans(models: list[Boosted]) -> Column:
    def chosen(c: Column) -> Column:
        good = F.lit(False)
        for number, model in enumerate(models):
            good = good | ((c["kind"] == number) & (model.score(c["code"]) >= model.threshold))
        return ~c["clash"] & c["good"] & good

    added = F.transform(F.filter("_wide", chosen), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
    ordered = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return ordered(F.concat(F.col("_base"), added))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, base and spans, arrays of (start, kind, end) by
    start and kind; kind is a place in KINDS. spans holds base and what the model adds."""
    found = materialize(with_candidates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "_base", "_wide"), "pii-candidates")
    base = F.array_sort(F.transform("_base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return found.select("doc_id", base.alias("base"), _all_spans(train(found)).alias("spans"))


def _only(number: int):
    return lambda x: F.when(x == number, x)


def digest(found: DataFrame) -> DataFrame:
    """find_pii()'s rows as counts of base spans, digest of base spans and text of all spans."""
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.array_compact(F.transform(kinds, _only(n)))).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by its kind in brackets; spans that
    overlap are replaced together, under the first one's kind. Same columns."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    rows = with_candidates(docs.select(F.struct(*cols).alias("_row"), F.col("text")))
    models = train(rows)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("text")
    walk = F.aggregate(
        F.col("_spans"),
        start,
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.element_at(names, s["kind"] + 1)).alias("out")),
        ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    rows = rows.withColumn("_spans", _all_spans(models)).withColumn("_new", F.when(F.size("_spans") > 0, walk).otherwise(text))
    fields = [F.col("_new").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return rows.select(*fields)


