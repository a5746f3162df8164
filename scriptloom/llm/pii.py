"""Personal data by candidate gradient boosting, in built-in columns only.

Generators propose spans: the strict patterns of each kind, and looser or shorter ones that
overlap them. Each candidate gets format features (does its checksum or range hold, digits,
separators, sign) and context features (what stands next to it, telling words before it).
Loose candidates have weak labels, which come from checksum, range and context and not from
the strict patterns (`_weak`). For each loose generator boosted trees learn them from the
counts of feature combinations, of which there is a fixed number; the least score that is
precise enough on the other half of the documents is its threshold. The strict spans always
stay; candidates over the threshold of their generator join them. Where a generator has too
few candidates for a threshold, or none is precise enough, its weak labels decide.

The trees score as one expression, so nothing leaves the JVM but the table of combinations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import let, stored

KINDS = ("email", "ip", "card", "phone")

# A match of these is what the plain pattern finds leftmost: starts inside a run that has
# failed as a whole are skipped, and possessive groups are used where nothing follows.
_LOCAL = "[A-Za-z0-9._%+-]"
STRICT = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Other shapes: short of what runs on, spelt out, or without the sign of the strict pattern.
LOOSE = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._+-]{0,63} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}"
    r"(?:(?:(?: ?[\[(]dot[\])] ?| \. | ?\.)[A-Za-z0-9-]{1,63}){0,126}(?: ?[\[(]dot[\])] ?| \. | ?\.)[A-Za-z]{2,24}|(?: ?\. [A-Za-z]{2,24}){1,126})",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[\x20.-]?|(?<![0-9+]))\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])",
}
TELLING = {
    "email": "e-?mail|contact|write|reach|mailto",
    "ip": "\\bip\\b|host|server|address|client",
    "card": "card|visa|amex|payment|credit",
    "phone": "phone|tel\\b|call|mobile|fax|cell",
}
CONTEXT = 24
#: Least digits of a candidate, by kind; fewer are nothing of the sort.
LEAST_DIGITS = {"email": 0, "ip": 4, "card": 12, "phone": 8}

FEATURES = ("kind", "loose", "sign", "holds", "form", "inside", "digits", "marks", "left", "right", "told")
TREES = 30
RATE = 0.3
PENALTY = 1.0
PRECISION = 0.98
LEAST_SUPPORT = 20

_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP = rf"^{_PART}(?:\.{_PART}){{3}}$"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether 16 to 19 digits have a valid check digit."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substr(digits, n - i, F.lit(1))) - 48
        return total + F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.when(
        n.between(16, 19), F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0
    ).otherwise(False)


def _holds(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(_IP)
    if kind == "card":
        return let(_digits(match), _luhn)
    return F.length(_digits(match)).between(8, 15)


def _form(kind: str, loose: bool, match: Column) -> Column:
    """Whether a candidate keeps to a narrower form: what dots, issuers and area codes look like."""
    if kind == "email" and loose:
        return ~match.rlike(r" \.|\. ")
    if kind == "card":
        return _digits(match).rlike("^(?:[3456]|2[2-7])")
    if kind == "phone":
        return _digits(match).rlike("^1?[2-9][0-9]{2}[2-9][0-9]{6}$")
    return F.lit(True)


def _weak(c: Column, inside: Column) -> Column:
    """The weak label of a loose candidate, by kind, from checksum, range and context.

    Spelt-out addresses: their dots are in brackets or have no blanks beside them, or a
    telling word is near. Addresses in range. Cards: check digit and issuer. Phone numbers:
    with a sign; without one and outside strict spans, after a telling word or with area code
    and exchange in range and with brackets, dots or hyphens. None may run on.
    """
    clear = (c["left"] == 0) & (c["right"] == 0)
    holds, form, told = (c[f] == 1 for f in ("holds", "form", "told"))
    return (
        F.when(c["kind"] == KINDS.index("email"), (c["right"] != 1) & (form | told))
        .when(c["kind"] == KINDS.index("ip"), holds & (c["left"] != 1) & (c["right"] != 1))
        .when(c["kind"] == KINDS.index("card"), holds & form & clear)
        .otherwise(holds & clear & ((c["sign"] == 1) | (~inside & (told | (form & (c["marks"] >= 2))))))
    )


def matches(text: Column, pattern: str) -> Column:
    """The matches of a pattern with their places: array of (start, end, match), in code points."""

    def place(found: Column) -> Column:
        nothing = F.array().cast("array<struct<start:int,end:int,match:string>>")

        def step(done: Column, i: Column) -> Column:
            m = F.get(found["m"], i)
            start = done["at"] + F.length(F.get(found["gaps"], i))
            return let(
                F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("match")),
                lambda s: F.struct(s["end"].alias("at"), F.concat(done["out"], F.array(s)).alias("out")),
            )

        return F.aggregate(
            F.sequence(F.lit(0), F.size(found["m"]) - 1),
            F.struct(F.lit(0).alias("at"), nothing.alias("out")),
            step,
            lambda done: done["out"],
        )

    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda m: F.when(
            F.size(m) > 0, let(F.struct(m.alias("m"), F.split(text, pattern, -1).alias("gaps")), place)
        ).otherwise(none),
    )


def _candidates(text: Column, kind: str, loose: bool) -> Column:
    """Candidates of one generator, with their features."""
    pattern = (LOOSE if loose else STRICT)[kind]
    number = KINDS.index(kind)

    def describe(s: Column) -> Column:
        before = F.substr(
            text, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT))
        )
        after = F.substr(text, s["end"] + 1, F.lit(2))
        n = F.length(_digits(s["match"]))
        return F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.lit(number).alias("kind"),
            F.lit(int(loose)).alias("loose"),
            s["match"].startswith("+").cast("int").alias("sign"),
            _holds(kind, s["match"]).cast("int").alias("holds"),
            _form(kind, loose, s["match"]).cast("int").alias("form"),
            F.when(n < 8, 0).when(n < 12, 1).when(n < 16, 2).when(n < 20, 3).otherwise(4).alias("digits"),
            F.when(~s["match"].rlike(r"[\x20().-]"), 0)
            .when(s["match"].rlike("[()]"), 2)
            .when(s["match"].rlike("[.-]"), 3)
            .otherwise(1)
            .alias("marks"),
            F.when(before.rlike(r"[0-9A-Za-z]$"), 1).when(before.rlike(r"[0-9][.-]$"), 2).otherwise(0).alias("left"),
            F.when(after.rlike(r"^[0-9A-Za-z]"), 1).when(after.rlike(r"^[.-][0-9]"), 2).otherwise(0).alias("right"),
            before.rlike(f"(?i)(?:{TELLING[kind]})").cast("int").alias("told"),
            n.alias("n"),
        )

    found = matches(text, pattern)
    if LEAST_DIGITS[kind]:
        found = F.filter(found, lambda s: F.length(_digits(s["match"])) >= LEAST_DIGITS[kind])
    sign = {"email": "@" if not loose else "at", "phone": "+" if not loose else ""}.get(kind, "")
    made = F.transform(found, describe)
    if sign:
        made = F.when(F.contains(text, F.lit(sign)), made).otherwise(F.slice(made, 1, 0))
    return made


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, strict, cands): the strict spans and all candidates of each text."""
    text = F.coalesce("text", F.lit(""))
    every = [(k, loose) for loose in (False, True) for k in KINDS]
    rows = docs.select("doc_id", text.alias("text")).select(
        "doc_id", *[_candidates(F.col("text"), k, loose).alias(f"c{i}") for i, (k, loose) in enumerate(every)]
    )
    columns = [F.coalesce(f"c{i}", F.array().cast(rows.schema[f"c{i}"].dataType)) for i in range(len(every))]
    return rows.select("doc_id", F.concat(*columns).alias("cands"))


def _labelled(cands: Column) -> Column:
    """Each candidate with `inside` (part of a strict span), `strict` (it is one) and `label`."""
    strict = F.filter(cands, lambda c: (c["loose"] == 0) & (c["holds"] == 1))

    def mark(c: Column, base: Column) -> Column:
        within = F.exists(
            base,
            lambda b: (b["start"] <= c["start"]) & (b["end"] >= c["end"]) & ((b["start"] < c["start"]) | (b["end"] > c["end"])),
        )
        return let(
            (c["loose"] == 1) & within,
            lambda inside: F.struct(
                *[(inside.cast("int") if f == "inside" else c[f]).alias(f) for f in (*FEATURES, "start", "end")],
                ((c["loose"] == 0) & (c["holds"] == 1)).cast("int").alias("strict"),
                F.when(c["loose"] == 0, c["holds"]).otherwise(_weak(c, inside).cast("int")).alias("label"),
            ),
        )

    return let(
        F.transform(strict, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))),
        lambda base: F.transform(cands, lambda c: mark(c, base)),
    )


def boost(counts: list[dict]) -> list[tuple]:
    """Boosted trees of depth two from rows of FEATURES with `n` and `positive`.

    A tree is (test, leaf or (test, yes, no), ...); a test is (feature, value), true on equality
    or, with value None, never. The rows are combinations of features, a fixed number at most.
    """
    score = [0.0] * len(counts)
    trees = []
    tests = sorted({(f, r[f]) for r in counts for f in FEATURES})

    def leaf(rows):
        g = sum(counts[i]["positive"] - counts[i]["n"] * p[i] for i in rows)
        h = sum(counts[i]["n"] * p[i] * (1 - p[i]) for i in rows)
        return g, h

    def worth(g, h):
        return g * g / (h + PENALTY)

    def split(rows):
        whole = worth(*leaf(rows))
        best = (1e-9, None, rows, [])
        for f, v in tests:
            yes = [i for i in rows if counts[i][f] == v]
            if yes and len(yes) < len(rows):
                no = [i for i in rows if counts[i][f] != v]
                gain = worth(*leaf(yes)) + worth(*leaf(no)) - whole
                if gain > best[0]:
                    best = (gain, (f, v), yes, no)
        return best[1:]

    for _ in range(TREES):
        p = [1 / (1 + math.exp(-s)) for s in score]
        tree = []
        test, yes, no = split(range(len(counts)))
        for side, rows in ((True, yes), (False, no)):
            if not rows:
                continue
            inner, a, b = split(rows)
            for inner_side, part in ((True, a), (False, b)):
                if part:
                    g, h = leaf(part)
                    value = RATE * g / (h + PENALTY)
                    tree.append((test, side, inner, inner_side, value))
                    for i in part:
                        score[i] += value
        trees.append(tuple(tree))
    return trees


def tree_score(trees: list[tuple], row) -> Column | float:
    """The sum of all trees for a row of features: a column for columns, a number for numbers."""
    numbers = isinstance(row, dict)
    total = 0.0 if numbers else F.lit(0.0)
    for tree in trees:
        value = None
        for test, side, inner, inner_side, leaf in tree:
            if numbers:
                hit = all(t is None or (row[t[0]] == t[1]) == want for t, want in ((test, side), (inner, inner_side)))
                total += leaf if hit else 0.0
                continue
            hit = F.lit(True)
            for t, want in ((test, side), (inner, inner_side)):
                if t is not None:
                    hit = hit & ((row[t[0]] == t[1]) if want else (row[t[0]] != t[1]))
            value = F.when(hit, leaf) if value is None else value.when(hit, leaf)
        if value is not None:
            total = total + value.otherwise(0.0)
    return total


def threshold(trees: list[tuple], counts: list[dict]) -> float:
    """The least score from which on the spans of a generator are precise enough.

    Combinations that are mostly none never set it, however few they are.
    """
    by_score: dict[float, list[int]] = {}
    for r in counts:
        both = by_score.setdefault(tree_score(trees, r), [0, 0])
        both[0], both[1] = both[0] + r["n"], both[1] + r["positive"]
    n = hits = 0
    least = math.inf
    for s, (many, positive) in sorted(by_score.items(), reverse=True):
        n, hits = n + many, hits + positive
        if positive >= many / 2 and n >= LEAST_SUPPORT and hits >= PRECISION * n:
            least = s
    return least


def find_spans(docs: DataFrame, seed: int = 42) -> DataFrame:
    """Documents (doc_id, text) to (doc_id, spans): array of (kind, start, end, strict), in order.

    Kinds are numbered as in KINDS; places are code points, ends exclusive. Null texts count
    as empty. Repeated rows are searched each; a null doc_id is carried; other columns are
    not read. An empty table gives an empty result. Without enough candidates of a loose
    generator to judge a threshold by, those with the weak label join the strict spans.
    """
    made, _ = stored(candidates(docs).select("doc_id", _labelled(F.col("cands")).alias("cands")), "pii-candidates")
    half = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(2)).alias("half")
    counts = (
        made.where(F.size("cands") > 0)
        .select(half, F.explode("cands").alias("c"))
        .where("c.loose = 1")
        .groupBy("half", *[F.col(f"c.{f}").alias(f) for f in FEATURES])
        .agg(F.count(F.lit(1)).alias("n"), F.sum("c.label").alias("positive"))
    )
    rows = [r.asDict() for r in counts.orderBy("half", *FEATURES).collect()]
    learned = {}
    for kind in range(len(KINDS)):
        own = [r for r in rows if r["kind"] == kind]
        trees = boost([r for r in own if r["half"] == 0])
        learned[kind] = trees, threshold(trees, [r for r in own if r["half"] == 1])

    def chosen(c: Column) -> Column:
        take = F.when(c["loose"] == 0, c["strict"] == 1)
        for kind, (trees, least) in learned.items():
            if least < math.inf:
                take = take.when(c["kind"] == kind, tree_score(trees, c) >= least - 1e-9)
        return take.otherwise(c["label"] == 1)

    spans = F.transform(
        F.filter("cands", chosen),
        lambda c: F.struct(*[c[x].cast("int").alias(x) for x in ("kind", "start", "end", "strict")]),
    )
    # A span that two generators propose stays once, as the strict one if it is.
    return made.select("doc_id", F.array_sort(spans).alias("spans")).select(
        "doc_id",
        F.filter(
            "spans",
            lambda s: (s["strict"] == 1)
            | ~F.exists(
                "spans",
                lambda o: (o["strict"] == 1) & (o["kind"] == s["kind"]) & (o["start"] == s["start"]) & (o["end"] == s["end"]),
            ),
        ).alias("spans"),
    )


def joined(spans: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def redact(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the kind of its first one."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(done: Column, s: Column) -> Column:
        new = s["start"] >= done["at"]
        piece = F.concat(F.substr(text, done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0))), F.get(names, s["kind"]))
        return F.struct(
            F.concat(done["out"], F.when(new, piece).otherwise(F.lit(""))).alias("out"),
            F.greatest(done["at"], s["end"]).alias("at"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(
        order, start, step, lambda d: F.concat(d["out"], F.substr(text, d["at"] + 1, F.length(text)))
    )


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of strict spans, their digest, and all spans as text."""
    rows = find_spans(docs)
    strict = F.filter("spans", lambda s: s["strict"] == 1)

    def many(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: (s["strict"] == 1) & (s["kind"] == kind))).cast("long")

    return rows.select(
        "doc_id",
        *[many(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(joined(strict), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
