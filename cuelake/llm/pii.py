"""Personal data by weak supervision (operator 5).

Patterns propose spans.  Three labelers vote on each: the strict form of its kind, a
gazetteer (domains, prefixes, country codes), and words just before it.  Expectation-
maximisation over the counts of vote patterns estimates how reliable the labelers are;
its posteriors train a naive Bayes classifier over the votes and the span's shape, which
decides on spans beyond the base rules.  Base spans always stay.  DataFrame functions only.

Models see counts of (kind, votes, shape): a bounded number of cells, whatever the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions.let import bound
from cuelake.llm.common import fresh, stored

# The base kinds in order, with their patterns.  The possessive forms match what
# the plain ones match: a run that is followed by what it cannot hold is never given back, and a
# start inside a run is only tried where an earlier match ended there.
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

#: Kinds that only the method can add: credentials, national ids and bank accounts, local
#: phone numbers.
ADDED = {
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+",
    "idnum": r"(?<![A-Za-z0-9])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+)(?![A-Za-z0-9])",
    "localphone": r"(?<![0-9A-Za-z+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9A-Za-z])",
}
KINDS = [*BASE, *ADDED]

#: What a match of a kind holds; texts without it are not searched for that kind, and texts
#: with neither a digit nor a commercial at are not searched at all.
NEEDS = {"email": "@", "phone": "+"}
SPAN = "array<struct<kind:int,start:int,end:int,base:boolean,v1:int,v2:int,v3:int,shape:int>>"

#: Words before a span that speak for it, by kind; the last BEFORE characters are looked at.
BEFORE = 32
CONTEXT = {
    "email": "mail|contact|write|reach|kontakt|correo|courriel",
    "ip": r"\bip\b|address|server|host|login|adresse|direcci",
    "card": "card|visa|master|amex|credit|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|anruf|appel|llam",
    "secret": "token|secret|passw|key|auth|bearer|credential",
    "idnum": r"\bssn\b|social|iban|passport|\bid\b|ausweis",
    "localphone": "phone|call|tel|mobile|fax|anruf|appel|llam",
}
#: Gazetteers as patterns on the span itself: known endings, issuers, country codes and prefixes.
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$",
    "ip": r"^(?!0|10\.|127\.|169\.254\.|192\.168\.|22[4-9]|2[3-5][0-9])",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|sk[-_].*|ghp_.*|AKIA.*|xox.*)$",
    "idnum": r"^(?:[0-8][0-9]{2}-|(?:DE|FR|ES|GB|IT|NL|BE|AT|CH)[0-9]{2})",
    "localphone": r"^\(?[2-9]",
}
STRICT = {
    "secret": r"^(?=.*[0-9].*[0-9].*[0-9])(?=.*[A-Za-z]).{32,}$",
    "idnum": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$|^[A-Z]{2}[0-9]{2}[0-9A-Z]{14,}$",
    "localphone": r"^\(?[2-9][0-9]{2}\)?[.\x20-]{0,1}[2-9][0-9]{2}[.\x20-][0-9]{4}$",
}


def digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a text of digits passes Luhn."""
    def term(i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(F.pmod(F.length(number) - i, F.lit(2)) == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda acc, i: acc + term(i))
    return F.pmod(total, F.lit(10)) == 0


def passes(kind: str, span: Column) -> Column:
    """The base check of a match, or the strict form of an added kind."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return span.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return bound(digits(span), lambda n: F.length(n).between(13, 19) & F.when(F.length(n).between(13, 19), luhn(n)).otherwise(False))
    if kind == "phone":
        return F.length(digits(span)).between(9, 15)
    return span.rlike(STRICT[kind])


def matches(text: Column, kind: str) -> Column:
    """array<struct<start, span, before>> of a kind's matches: the gaps between matches give the places."""
    pattern = F.lit({**BASE, **ADDED}[kind])

    def places(gaps: Column, spans: Column) -> Column:
        pairs = F.zip_with(gaps, spans, lambda g, m: F.struct(g.alias("gap"), m.alias("span")))
        return bound(F.filter(pairs, lambda x: x["span"].isNotNull()), ordered)

    def ordered(pairs: Column) -> Column:
        ends = F.transform(pairs, lambda x: F.length(x["gap"]) + F.length(x["span"]))
        return bound(running(ends), lambda sums: F.transform(pairs, lambda x, i: F.struct(
            (F.get(sums, i) - F.length(x["span"])).alias("start"), x["span"].alias("span"),
            F.right(x["gap"], F.lit(BEFORE)).alias("before"))))

    found = bound(F.regexp_extract_all(text, pattern, F.lit(0)), lambda spans: F.when(
        F.size(spans) > 0, places(F.split(text, {**BASE, **ADDED}[kind], -1), spans)))
    if kind in NEEDS:
        found = F.when(F.contains(text, F.lit(NEEDS[kind])), found)
    return F.coalesce(found, F.array().cast("array<struct<start:int,span:string,before:string>>"))


def running(values: Column) -> Column:
    """Running sums of an array: blocks of 64 first, so that long arrays stay near linear."""
    block = 64
    n = F.size(values)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(n / block).cast("int") - 1, F.lit(0)))
    sums = F.transform(starts, lambda b: F.aggregate(F.slice(values, b * block + 1, F.lit(block)), F.lit(0), lambda a, x: a + x))
    return bound(sums, lambda totals: bound(
        F.transform(starts, lambda b: F.aggregate(F.slice(totals, F.lit(1), b), F.lit(0), lambda a, x: a + x)),
        lambda bases: F.transform(values, lambda _, i: F.get(bases, F.floor(i / block).cast("int")) + F.aggregate(
            F.slice(values, F.floor(i / block).cast("int") * block + 1, F.pmod(i, F.lit(block)) + 1), F.lit(0), lambda a, x: a + x))))


def shape(span: Column) -> Column:
    """A span's form in one of 12 cells: length band, and whether it has letters, and signs."""
    band = F.when(F.length(span) < 14, 0).when(F.length(span) < 24, 1).otherwise(2)
    return band * 4 + F.when(span.rlike("[A-Za-z]"), 2).otherwise(0) + F.when(span.rlike("[^A-Za-z0-9]"), 1).otherwise(0)


def candidates(text: Column) -> Column:
    """array<struct<kind, start, end, base, v1, v2, v3, shape>> of a text; kind is a place in :data:`KINDS`."""
    def describe(number: int, kind: str):
        def described(m: Column) -> Column:
            strict = passes(kind, m["span"])
            return F.struct(
                F.lit(number).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["span"])).alias("end"),
                (strict if kind in BASE else F.lit(False)).alias("base"), strict.cast("int").alias("v1"),
                m["span"].rlike(GAZETTEER[kind]).cast("int").alias("v2"),
                m["before"].rlike("(?i)" + CONTEXT[kind]).cast("int").alias("v3"), shape(m["span"]).alias("shape"))

        return described

    parts = []
    for number, kind in enumerate(KINDS):
        found = F.transform(matches(text, kind), describe(number, kind))
        # Of the base kinds a failing match is dropped; its text may still be of an added kind.
        parts.append(F.filter(found, lambda c: c["base"]) if kind in BASE else found)
    return F.when(text.rlike("[0-9@]"), F.concat(*parts)).otherwise(F.array().cast(SPAN))


def em(cells: DataFrame, rounds: int = 8) -> dict[int, tuple[float, list[tuple[float, float]]]]:
    """Per kind: share of true spans, and each labeler's chance to vote yes on (true, other) spans.

    ``cells(kind, v1, v2, v3, shape, n)`` has a bounded number of rows; every round is one aggregate
    over them, and its few sums are the next round's parameters.  Smoothed by one span.
    """
    kinds = [r.kind for r in cells.select("kind").distinct().collect()]
    state = {k: (0.5, [(0.8, 0.2)] * 3) for k in kinds}
    for _ in range(rounds if kinds else 0):
        p = posterior(state)
        sums = cells.groupBy("kind").agg(
            F.sum("n").alias("n"), F.sum(p * F.col("n")).alias("p"),
            *[F.sum(p * F.col("n") * F.col(v)).alias(f"{v}_yes") for v in ("v1", "v2", "v3")],
            *[F.sum(F.col("n") * F.col(v)).alias(f"{v}_all") for v in ("v1", "v2", "v3")]).collect()
        for r in sums:
            rest = r.n - r.p
            state[r.kind] = ((r.p + 1) / (r.n + 2), [
                ((r[f"{v}_yes"] + 1) / (r.p + 2), (r[f"{v}_all"] - r[f"{v}_yes"] + 1) / (rest + 2)) for v in ("v1", "v2", "v3")])
    return state


def posterior(state: dict) -> Column:
    """Chance that a cell's spans are true, from its votes."""
    out = F.lit(0.0)
    for kind, (share, rates) in state.items():
        odds = F.lit(math.log(share / (1 - share)))
        for v, (yes, no) in zip(("v1", "v2", "v3"), rates):
            odds = odds + F.when(F.col(v) == 1, math.log(yes / no)).otherwise(math.log((1 - yes) / (1 - no)))
        out = F.when(F.col("kind") == kind, 1 / (1 + F.exp(-odds))).otherwise(out)
    return out


def classifier(cells: DataFrame, state: dict) -> dict[tuple[int, int, int, int, int], float]:
    """Naive Bayes over votes and shape, trained on the posteriors; the chance of each cell seen.

    The table has at most one row per kind, vote pattern and shape (8 x 8 x 12).
    """
    if not state:
        return {}
    scored = cells.withColumn("p", posterior(state))
    by = lambda *keys: scored.groupBy(*keys).agg(F.sum(F.col("p") * F.col("n")).alias("yes"), F.sum((1 - F.col("p")) * F.col("n")).alias("no"))
    total = by("kind").withColumnsRenamed({"yes": "t_yes", "no": "t_no"})
    out = scored.join(total, "kind")
    odds = F.log((F.col("t_yes") + 1) / (F.col("t_no") + 1))
    for feature in ("v1", "v2", "v3", "shape"):
        width = 12 if feature == "shape" else 2
        part = by("kind", feature).withColumnsRenamed({"yes": f"{feature}_yes", "no": f"{feature}_no"})
        out = out.join(part, ["kind", feature])
        odds = odds + F.log((F.col(f"{feature}_yes") + 1) / (F.col("t_yes") + width)) - F.log((F.col(f"{feature}_no") + 1) / (F.col("t_no") + width))
    rows = out.select("kind", "v1", "v2", "v3", "shape", odds.alias("odds")).collect()
    return {(r.kind, r.v1, r.v2, r.v3, r["shape"]): r.odds for r in rows}


def accepted(odds: dict, least: float) -> Column:
    """array<string> of the cells whose spans the classifier takes."""
    names = sorted("/".join(map(str, cell)) for cell, x in odds.items() if KINDS[cell[0]] in ADDED and x > math.log(least / (1 - least)))
    return F.array(*[F.lit(n) for n in names]).cast("array<string>")


def chosen(found: Column, cells: Column) -> Column:
    """Base spans, and added ones that the classifier takes and no base span overlaps, by kind and start."""
    base = F.filter(found, lambda c: c["base"])
    name = lambda c: F.concat_ws("/", c["kind"], c["v1"], c["v2"], c["v3"], c["shape"])
    added = F.filter(found, lambda c: ~c["base"] & F.array_contains(cells, name(c)))
    free = bound(base, lambda b: F.filter(added, lambda c: ~F.exists(b, lambda x: (x["start"] < c["end"]) & (c["start"] < x["end"]))))
    return F.concat(base, free)


def fit(found: DataFrame, least: float = 0.9) -> Column:
    """Cells to take, learned from ``found(found)``: the candidate arrays of all rows."""
    cells = stored(found.select(F.explode("found").alias("c")).select("c.kind", "c.v1", "c.v2", "c.v3", "c.shape")
                   .groupBy("kind", "v1", "v2", "v3", "shape").agg(F.count("*").alias("n")), "pii-cells")
    return accepted(classifier(cells, em(cells)), least)


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"], c["end"])), ",")


def find_spans(docs: DataFrame, least: float = 0.9) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: counts of the base kinds, hash of their list, and all spans.

    Places are code points, ends exclusive.  Null texts are empty and have no span; null
    and repeated ids stay rows of their own.
    """
    text = F.coalesce("text", F.lit(""))
    found = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), candidates(text).alias("found")), "pii-spans")
    cells = fit(found, least)
    base = F.filter("found", lambda c: c["base"])
    count = lambda number: F.size(F.filter(base, lambda c: c["kind"] == number)).cast("long")
    return found.select(
        "doc_id", *[count(n).alias(f"n_{kind}") for n, kind in enumerate(BASE)],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(chosen(F.col("found"), cells)).alias("spans"))


def redact(docs: DataFrame, least: float = 0.9) -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in angle brackets.

    Overlapping spans become one, named after the first.  ``n_chars``, where it is a column, follows
    the new text; texts without a span, and all other columns, stay as they are.
    """
    spans_name = fresh(docs.columns, "found")
    source = stored(docs.withColumn(spans_name, candidates(F.coalesce("text", F.lit("")))), "pii-docs")
    cells = fit(source.select(F.col(spans_name).alias("found")), least)
    spans = F.array_sort(F.transform(chosen(F.col(spans_name), cells), lambda c: F.struct(c["start"], c["end"], c["kind"])))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def step(acc: Column, c: Column) -> Column:
        inside = c["start"] < acc["at"]
        piece = F.concat(F.substring(F.col("text"), acc["at"] + 1, c["start"] - acc["at"]), F.get(names, c["kind"]))
        return F.struct(F.greatest(acc["at"], c["end"]).alias("at"),
                        F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(piece))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    cleaned = bound(F.aggregate(spans, start, step), lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    text = F.when(F.size(spans) > 0, cleaned).otherwise(F.col("text"))
    out = source.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = F.size(spans) > 0
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
