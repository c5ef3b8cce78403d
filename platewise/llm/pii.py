r"""Personal data by pattern, checksum and context, with Spark expressions only (operator 10).

Regular expressions propose spans; checksum validators (Luhn for cards, mod-97
for international account numbers, ranges and digit counts elsewhere) confirm
them; words near a span raise its score.  Base kinds are ``email``, ``ip``,
``card`` and ``phone``: every match that its validator confirms is a span,
whatever its score.  Added kinds are ``iban`` (mod-97), ``ssn`` (a number of the
form 3-2-4) and ``secret`` (a long token), the last two only with a context word
near, before or after.  The score is 0.6 for a confirmed match and 0.9 with a
context word near.

Offsets are code points, end exclusive.  The places of the matches of a pattern
come from the lengths of the matches and of the pieces between them, by prefix sums,
and what lies around a place is read from the text cut into stretches, so that the work
on a text follows its length and its matches.  Patterns
hold possessive repeats and look-behinds where these leave the matches as they
are and keep the time linear in the text.

Rows: null text counts as empty; very long texts are searched in whole; repeated
rows are kept and searched one by one; spans of different kinds may share
characters (``redact`` merges those that do, and the one that begins first names
them; a tie goes to the shorter, then to the first name); an empty table gives
an empty result; other columns are kept by ``redact`` and ignored by ``find_spans``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns, as Java regular expressions.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+",
}
#: A character without which the pattern cannot match, to skip texts early.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
BASE_KINDS = ("email", "ip", "card", "phone")
#: Context words (lower case) and how far before or after a span they count, in code points.
CONTEXT = {
    "email": "mail|contact|write to",
    "ip": "ip|address|host|server",
    "card": "card|visa|credit|payment|account",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security",
    "secret": "token|secret|password|passwd|api[_ -]?key",
}
CONTEXT_CHARS = 40
#: Code points of the stretches that a text is cut into, to find places in it.
STRETCH = 1024
#: Score of a confirmed match, what a context word adds, and the least score of a span of each added kind.
CONFIRMED, CONTEXT_BONUS = 0.6, 0.3
LEAST = {"iban": 0.5, "ssn": 0.8, "secret": 0.8}


SPAN = "struct<kind: string, start: int, end: int, score: double>"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def luhn_ok(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""

    def part(d, i):
        n = d.cast("int")
        return F.when(i % 2 == 1, n * 2 - F.when(n > 4, 9).otherwise(0)).otherwise(n)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), part), F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97_ok(account: Column) -> Column:
    """Whether an account number (letters and digits) leaves 1 modulo 97 after its first four are moved to the end."""
    moved = F.split(F.concat(F.substr(account, F.lit(5)), F.substring(account, 1, 4)), "")
    return F.aggregate(moved, F.lit(0), lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)) == 1


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, "[.]"), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) <= 3) & (F.coalesce(q.try_cast("int"), F.lit(0)) <= 255)))
    if kind == "card":
        return let(digits, lambda d: F.when(F.length(d).between(13, 19), luhn_ok(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return let(F.replace(m, F.lit(" "), F.lit("")), lambda p: F.when(F.length(p).between(15, 34), mod97_ok(p)).otherwise(False))
    if kind == "ssn":
        return ~(F.substring(m, 1, 3).isin("000", "666") | m.startswith("9") | (F.substring(m, 5, 2) == "00") | m.endswith("0000"))
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


def _stretches(text: Column) -> Column:
    """A text cut into stretches of ``STRETCH`` code points, so that a place in it is found without a way from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))


def _between(stretches: Column, a: Column, b: Column) -> Column:
    """The text from place ``a`` to before ``b``."""
    first = F.floor(a / STRETCH).cast("int")
    last = F.floor(F.greatest(b - 1, a) / STRETCH).cast("int")
    return F.substr(F.array_join(F.slice(stretches, first + 1, last - first + 1), ""), (a - first * STRETCH + 1).cast("int"), (b - a).cast("int"))


def _running(values: Column, join) -> Column:
    """Sums (or maxima, as ``join`` says) of an array up to each place, by doubling: round ``k`` takes in what lies ``2**k`` places before."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int") - 1)
    back = lambda k: F.call_function("shiftleft", F.lit(1), k)
    return F.aggregate(rounds, values, lambda done, k: F.transform(done, lambda x, i: F.when(i >= back(k), join(x, F.get(done, i - back(k)))).otherwise(x)))


def _spans(text: Column, stretches: Column, size: Column, kind: str) -> Column:
    """Array of the spans of one kind, by start; ``size`` is the text's length."""
    pattern, empty = PATTERNS[kind], F.array().cast(f"array<{SPAN}>")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(matches, F.split(text, pattern, -1), lambda m, gap: F.struct(m.alias("m"), (F.length(gap) + F.coalesce(F.length(m), F.lit(0))).alias("n")))

    def score(start: Column, end: Column) -> Column:
        near = F.concat(_between(stretches, F.greatest(start - CONTEXT_CHARS, F.lit(0)), start), F.lit(" "), _between(stretches, end, F.least(end + CONTEXT_CHARS, size)))
        return F.lit(CONFIRMED) + F.when(near.rlike(f"(?i)(?<![a-z])(?:{CONTEXT[kind]})(?![a-z])"), CONTEXT_BONUS).otherwise(0.0)

    def placed(p: Column) -> Column:
        def span(x: Column, end: Column) -> Column:
            start = end - F.length(x["m"])
            return F.when(x["m"].isNotNull() & _valid(kind, x["m"]), F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), score(start, end).alias("score")))

        ends = _running(F.transform(p, lambda x: x["n"]), lambda a, b: a + b)
        return F.filter(F.zip_with(p, ends, span), lambda x: x.isNotNull())

    found = let(pairs, placed)
    if kind in LEAST:
        found = F.filter(found, lambda x: x["score"] >= LEAST[kind])
    possible = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("(?i)" + CONTEXT[kind]) if kind == "secret" else text.rlike(pattern)
    return F.when(possible, found).otherwise(empty)


def all_spans(text: Column, kinds: tuple[str, ...]) -> Column:
    """The spans of all ``kinds`` of a text, by kind as listed, then start."""
    return let(F.struct(_stretches(text).alias("parts"), F.length(text).alias("size")), lambda v: F.concat(*(_spans(text, v["parts"], v["size"], k) for k in kinds)))


def find_spans(docs: DataFrame, kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """``doc_id, text, spans``: arrays of (kind, start, end, score) by kind as listed, then start."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return plain.withColumn("spans", all_spans(F.col("text"), kinds))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by ``[KIND]``; spans that meet are one, named by the first."""
    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def merge(v: Column) -> Column:
        """Spans that none before them reaches, each with the end that those up to the next one reach."""
        reached = v["reached"]
        firsts = F.filter(F.sequence(F.lit(0), F.size(reached) - 1), lambda i: (i == 0) | (F.get(v["all"], i)["start"] >= F.get(reached, i - 1)))

        def cut(at: Column) -> Column:
            lasts = F.concat(F.transform(F.slice(at, F.lit(2), F.size(at)), lambda i: i - 1), F.array(F.size(reached) - 1))
            return F.zip_with(at, lasts, lambda i, k: F.struct(F.get(v["all"], i)["start"].alias("start"), F.get(reached, k).alias("end"), F.get(v["all"], i)["kind"].alias("kind")))

        return let(firsts, cut)

    def build(v: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            begin = F.when(i > 0, F.get(v["spans"], i - 1)["end"]).otherwise(0)
            return F.concat(_between(v["parts"], begin, x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))

        return F.concat(F.array_join(F.transform(v["spans"], piece), ""), _between(v["parts"], F.element_at(v["spans"], -1)["end"], F.length(text)))

    furthest = lambda s: F.struct(s.alias("all"), _running(F.transform(s, lambda x: x["end"]), F.greatest).alias("reached"))
    merged = let(let(ordered, furthest), merge)
    return F.when(F.size(spans) > 0, let(F.struct(merged.alias("spans"), _stretches(text).alias("parts")), build)).otherwise(text)


def redact(docs: DataFrame, kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """The rows of ``docs`` with spans masked in ``text`` and, where there is such a column, ``n_chars`` renewed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = all_spans(text, kinds)
    found = docs.withColumn("text", F.when(F.col("text").isNotNull(), let(spans, lambda s: masked(text, s))))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))
    return found.select(*docs.columns)


def span_digests(found: DataFrame) -> DataFrame:
    """Counts and digests of the base kinds, all spans as text, and their scores in the same order."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    scores = F.array_join(F.transform("spans", lambda x: x["score"].cast("decimal(2,1)").cast("string")), ",")
    return found.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), scores.alias("scores"))
