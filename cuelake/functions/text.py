"""Text scoring and tagging as built-in Column expressions (no Python UDFs)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_, or_
from re import _parser as regex_parser

from pyspark.sql import Column, functions as F

from cuelake import vocab
from cuelake.functions.let import bound

CASELESS = "(?i)"


def alternation(patterns: Sequence[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def required_literal(pattern: str) -> str:
    """Longest lower-case text that every match of ``pattern`` must contain ('' if none)."""
    best = run = ""
    for op, arg in regex_parser.parse(pattern):
        if str(op) == "LITERAL" and chr(arg).isascii():
            run += chr(arg).lower()
        else:
            best, run = max(best, run, key=len), ""
    return max(best, run, key=len)


def required_tokens(pattern: str, least: int = 2) -> list[frozenset[str]]:
    """What every match of ``pattern`` must contain: of each set, one of its lower-case literals.

    No literal has a blank, so where texts are joined by blanks, each lies in one of them.
    Literals of fewer than ``least`` characters are left out.
    """

    def of_sequence(items) -> list[frozenset[str]]:
        found, run = [], ""
        for op, arg in [*items, (None, None)]:
            if str(op) == "LITERAL" and chr(arg).isascii() and not chr(arg).isspace():
                run += chr(arg).lower()
                continue
            if len(run) >= least:
                found.append(frozenset([run]))
            run = ""
            if str(op) == "SUBPATTERN":
                found += of_sequence(arg[3])
            elif str(op) == "MAX_REPEAT" and arg[0] > 0:
                found += of_sequence(arg[2])
            elif str(op) == "BRANCH":
                ways = [of_sequence(way) for way in arg[1]]
                if all(ways):  # one set of each way: the one that is hardest to meet
                    found.append(frozenset().union(*(max(way, key=lambda c: min(map(len, c))) for way in ways)))
        return found

    return of_sequence(regex_parser.parse(pattern))


LEAD = 3


def leading_words(pattern: str) -> frozenset[str] | None:
    """How the word begins that a match of ``pattern`` begins with: its first ``LEAD`` characters, or all of a shorter word.

    None where that cannot be told, so also where a match need not begin at a word border.
    """

    def of_sequence(items: list, run: str) -> set[str] | None:
        if len(run) == LEAD:
            return {run}
        if not items:
            return None
        (op, arg), rest = items[0], items[1:]
        kind = str(op)
        if kind == "LITERAL" and chr(arg).isascii() and (chr(arg).isalnum() or chr(arg) == "_"):
            return of_sequence(rest, run + chr(arg).lower())
        if kind == "SUBPATTERN":
            return of_sequence([*arg[3], *rest], run)
        if kind == "BRANCH":
            ways = [of_sequence([*way, *rest], run) for way in arg[1]]
            return set().union(*ways) if all(ways) else None
        if kind == "MAX_REPEAT" and arg[0] == 0 and arg[1] == 1:
            ways = [of_sequence(rest, run), of_sequence([*arg[2], *rest], run)]
            return set().union(*ways) if all(ways) else None
        ends = (
            kind == "LITERAL" and chr(arg).isascii() or kind == "AT" and str(arg) == "AT_BOUNDARY"
            or kind == "MAX_REPEAT" and arg[0] > 0 and str(arg[2][0]) == "(IN, [(CATEGORY, CATEGORY_SPACE)])"
        )
        return {run} if run and ends else None

    items = list(regex_parser.parse(pattern))
    if not items or str(items[0][1]) != "AT_BOUNDARY":
        return None
    found = of_sequence(items[1:], "")
    return frozenset(found) if found else None


class TokenFilter:
    """Bit masks of the literals that matches of some patterns need, to rule texts out before they are scanned.

    Masks of texts that are joined by blanks may be combined by ``bit_or``.
    """

    def __init__(self, patterns: Sequence[str]):
        self.clauses = [required_tokens(p) for p in patterns]
        self.tokens = sorted({t for clauses in self.clauses for c in clauses for t in c})
        if len(self.tokens) > 63:
            raise ValueError(f"{len(self.tokens)} literals do not fit a mask")

    def bits(self, lowered: Column) -> Column:
        """Which literals the text has; null has none."""
        return reduce(
            lambda a, b: a.bitwiseOR(b),
            [F.when(F.contains(lowered, F.lit(t)), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint") for k, t in enumerate(self.tokens)])

    def mask(self, text: Column) -> Column:
        return found_in(text, mask=lambda _, low: self.bits(low))["mask"]

    def possible(self, mask: Column) -> Column:
        """Whether a text with this mask can match one of the patterns."""
        bit = {t: 1 << k for k, t in enumerate(self.tokens)}
        has = lambda clause: mask.bitwiseAND(F.lit(sum(bit[t] for t in clause)).cast("bigint")) != 0
        return reduce(or_, [reduce(and_, map(has, clauses), F.lit(True)) for clauses in self.clauses])


def fold(text: Column) -> Column:
    """``text`` for ASCII patterns with Unicode rules.

    Word borders, word characters, digits and blanks of the dictionaries mean those of any
    alphabet: other letters and numbers become underscores (which no pattern names), other
    blanks become blanks.  Four letters are case forms of ASCII ones.
    """
    plain = F.regexp_replace(F.translate(text, "ſ\u212aİı", "skii"), r"[\p{L}\p{N}&&[^\x00-\x7F]]", "_")
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(plain, r"[\p{Z}\x85]", " ")).otherwise(text)


def _with_lowered(text: Column, body: Callable[[Column, Column], Column]) -> Column:
    pair = bound(bound(text, fold), lambda t: F.struct(t.alias("t"), F.lower(t).alias("l")))
    return bound(pair, lambda p: body(p["t"], p["l"]))


def found_in(text: Column, **what: Callable[[Column, Column], Column]) -> Column:
    """Struct of what functions of (folded text, lower-case text) find; the text is folded and lowered once for all of them."""
    return _with_lowered(text, lambda t, low: F.struct(*[f(t, low).alias(name) for name, f in what.items()]))


def can_match(lowered: Column, pattern: str) -> Column | None:
    """Whether a text has all literals that a match of ``pattern`` needs (None if it needs none).

    Substring tests run over the bytes and are far cheaper than a caseless regular expression,
    and most texts fail the first.
    """
    literal = required_literal(pattern)
    clauses = [frozenset([literal])] if literal else []
    clauses += [c for c in required_tokens(pattern) if not any(t in literal for t in c)]
    clauses.sort(key=lambda c: -min(map(len, c)))
    has = lambda clause: reduce(or_, [F.contains(lowered, F.lit(t)) for t in sorted(clause)])
    return reduce(and_, map(has, clauses)) if clauses else None


def guarded_match(text: Column, lowered: Column, pattern: str) -> Column:
    """``text rlike pattern``, tried only where its mandatory literals occur."""
    possible, hit = can_match(lowered, pattern), text.rlike(CASELESS + pattern)
    return hit if possible is None else possible & hit


def possible_alternation(lowered: Column, patterns: Sequence[str]) -> Column:
    """The alternation of those ``patterns`` whose mandatory literals occur in a text, in their order ('' if none does).

    The others match nowhere in the text, and each would be tried at all its places.
    """
    parts = [(can_match(lowered, p), F.lit(f"(?:{p})")) for p in patterns]
    return F.concat_ws("|", *[part if possible is None else F.when(possible, part) for possible, part in parts])


def count_matches(text: Column, lowered: Column, patterns: Sequence[str]) -> Column:
    """Non-overlapping, leftmost-first matches of the alternation of ``patterns``."""
    return bound(possible_alternation(lowered, patterns), lambda some: F.when(
        some == "", F.when(text.isNotNull(), F.lit(0))).otherwise(F.regexp_count(text, F.concat(F.lit(CASELESS), some))))


def any_match(text: Column, lowered: Column, patterns: Sequence[str]) -> Column:
    return reduce(or_, [guarded_match(text, lowered, p) for p in patterns])


def matches_any(text: Column, patterns: Sequence[str]) -> Column:
    return _with_lowered(text, lambda t, low: any_match(t, low, patterns))


# ---------------------------------------------------------------------------
# phrase scores
# ---------------------------------------------------------------------------


def score_text(text: Column) -> Column:
    """3 per strong match plus 1 per weak match, 0 where the gate finds nothing."""
    return _with_lowered(
        text,
        lambda t, low: F.when(
            any_match(t, low, vocab.GATE_PHRASES),
            count_matches(t, low, vocab.STRONG_PHRASES) * 3 + count_matches(t, low, vocab.WEAK_PHRASES),
        ).otherwise(0),
    )


def score_cue(text: Column) -> Column:
    """3 per distinct strong pattern plus 1 per distinct weak one; no gate."""
    points = [(p, 3) for p in vocab.SIMPLE_STRONG_PHRASES]
    points += [(p, 1) for p in vocab.SIMPLE_WEAK_PHRASES]
    fired = _with_lowered(
        text,
        lambda t, low: F.array(*[
            F.when(guarded_match(t, low, p), F.lit(n)).otherwise(0) for p, n in points
        ]),
    )
    return F.aggregate(fired, F.lit(0), lambda a, b: a + b)


# ---------------------------------------------------------------------------
# indicator vectors
# ---------------------------------------------------------------------------


def keyword_vector(text: Column, patterns: Sequence[str] = vocab.VOCAB_PIPELINE) -> Column:
    """ARRAY<TINYINT>: 1 where the pattern of that dimension matches the text.

    The beginnings of a text's words, as far as patterns begin with them, make a short string; it rules out most patterns.
    """
    leads = [leading_words(p) for p in patterns]
    wanted = sorted(frozenset().union(*(lead for lead in leads if lead)))
    if not wanted:
        return _with_lowered(F.coalesce(text, F.lit("")), lambda t, low: F.array(*[guarded_match(t, low, p).cast("tinyint") for p in patterns]))

    def begins(low: Column) -> Column:
        words = F.regexp_extract_all(low, F.lit(rf"(\w{{1,{LEAD}}})\w*"), F.lit(1))
        return F.concat(F.lit(" "), F.array_join(F.array_intersect(words, F.array(*map(F.lit, wanted))), " "), F.lit(" "))

    def one(t: Column, low: Column, have: Column, pattern: str, lead: frozenset[str] | None) -> Column:
        hit = guarded_match(t, low, pattern)
        return hit if lead is None else reduce(or_, [F.contains(have, F.lit(f" {w} ")) for w in sorted(lead)]) & hit

    return _with_lowered(F.coalesce(text, F.lit("")), lambda t, low: bound(begins(low), lambda have: F.array(
        *[one(t, low, have, p, lead).cast("tinyint") for p, lead in zip(patterns, leads)])))


def vector_to_masks(vec: Column) -> list[Column]:
    """Two BIGINT bit masks (dims 0-63, 64-127): small to shuffle, pooled by ``bit_or``."""

    def mask(part: Column) -> Column:
        return F.aggregate(
            F.reverse(part),
            F.lit(0).cast("bigint"),
            lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(x.cast("bigint")),
        )

    return [mask(F.slice(vec, 1, 64)), mask(F.slice(vec, 65, 64))]


def masks_to_vector(low: Column, high: Column) -> Column:
    # shiftrightunsigned needs a literal count in the Python API; call by name.
    def part(mask: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(63)),
            lambda i: F.call_function("shiftrightunsigned", mask, i)
            .bitwiseAND(F.lit(1).cast("bigint"))
            .cast("tinyint"),
        )

    return F.concat(part(low), part(high))


def group_sum(vec: Column, group: int) -> Column:
    """Number of fired dimensions in one of the eight vocabulary groups."""
    return F.aggregate(
        F.slice(vec, group * vocab.GROUP_SIZE + 1, vocab.GROUP_SIZE),
        F.lit(0),
        lambda a, b: a + b.cast("int"),
    )


def keyword_score(vec: Column, groups: int = 8) -> Column:
    """Group-weighted sum over the first ``groups`` groups of 16 dimensions."""
    def weighted(v: Column) -> Column:
        total = F.lit(0.0)
        for g in range(groups):
            total = total + group_sum(v, g) * F.lit(vocab.GROUP_WEIGHTS[g])
        return total

    return bound(vec, weighted)


def keyword_count(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0), lambda a, b: a + b.cast("int"))


def pad_vector(vec: Column, size: int = vocab.N_DIMS) -> Column:
    """Extend legacy short vectors with zeros."""
    missing = F.greatest(F.lit(size) - F.size(vec), F.lit(0))
    return F.concat(vec, F.array_repeat(F.lit(0).cast("tinyint"), missing))


# ---------------------------------------------------------------------------
# localized tags, cleaning, formatting
# ---------------------------------------------------------------------------


def skip_tags(text: Column) -> Column:
    """Names of the localized wordings found in the trimmed text; blank gives none."""
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    found = F.array(
        *[F.when(trimmed.rlike(p), F.lit(name)) for name, p in vocab.SKIP_WORDINGS]
    )
    return F.when(
        trimmed == "", F.array().cast("array<string>")
    ).otherwise(F.filter(found, lambda t: t.isNotNull()))


def has_skip_wording(text: Column) -> Column:
    return F.size(skip_tags(text)) > 0


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]+>", "")


def unescape(text: Column) -> Column:
    for entity, char in vocab.ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def clean_caption(text: Column) -> Column:
    """Drop inline tags, undo the six character references, trim."""
    return F.trim(unescape(strip_tags(text)))


def one_line(text: Column) -> Column:
    return F.trim(F.replace(text, F.lit("\n"), F.lit(" ")))


def format_clock(seconds: Column) -> Column:
    """``m:ss`` of whole seconds."""
    whole = F.floor(seconds).cast("bigint")
    minutes = F.floor(whole / 60).cast("bigint")
    rest = (whole % 60).cast("string")
    return F.concat(minutes.cast("string"), F.lit(":"), F.lpad(rest, 2, "0"))
