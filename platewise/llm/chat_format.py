r"""Chat formatting with Spark expressions only (operator 1).

Turns of a conversation are collected as structs, sorted, adjacent turns of one
role are merged by array aggregation, and the blocks are concatenated:

    ### role\n
    text<seg>text</turn>\n

``<seg>`` parts the texts of a merged block, so that reading back gives the rows
again.  Inside roles and texts ``\``, ``#`` and ``<`` are written ``\\``, ``\h``
and ``\l`` (and a line feed in a role ``\n``); an escaped text therefore holds
neither ``#`` nor ``<`` and no control string can arise from it.

Rows: a null role or text counts as empty; a null conversation id forms one
conversation; null turns sort first; equal turns are ordered by role, then text;
repeated rows are separate turns; very long texts are copied as they are; an
empty table gives an empty result; other columns are ignored.  One conversation
is one output row, so its turns meet in one task by nature; the work on it grows
with its turns (times the logarithm of their number, for the places of the spans).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The role whose texts are learned.
LOSS_ROLE = "assistant"
#: Spans that are cut out together, from the widest groups to the narrowest.
SPAN_GROUPS = (16_384, 128)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _escape(c: Column) -> Column:
    for sign, written in (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l")):
        c = F.replace(c, F.lit(sign), F.lit(written))
    return c


def _unescape(c: Column) -> Column:
    def part(p: Column) -> Column:
        for written, sign in (("\\h", "#"), ("\\l", "<"), ("\\n", "\n")):
            p = F.replace(p, F.lit(written), F.lit(sign))
        return p

    return F.array_join(F.transform(F.split(c, r"\\\\", -1), part), "\\")


def _running_sums(lengths: Column) -> Column:
    """Inclusive prefix sums of an array, by doubling: round ``k`` adds what lies ``2**k`` places before."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(lengths), F.lit(2)))).cast("int") - 1)
    return F.aggregate(
        rounds,
        lengths,
        lambda sums, k: F.transform(sums, lambda x, i: x + F.when(i >= F.call_function("shiftleft", F.lit(1), k), F.get(sums, i - F.call_function("shiftleft", F.lit(1), k))).otherwise(F.lit(0).cast("long"))),
    )


def _blocks(turns: Column) -> Column:
    """Blocks (role, texts) of adjacent turns of one role."""
    places = F.sequence(F.lit(0), F.size(turns) - 1)
    starts = F.filter(places, lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))

    def cut(v: Column) -> Column:
        stops = F.concat(F.slice(v, F.lit(2), F.size(v)), F.array(F.size(turns)))
        return F.zip_with(
            v, stops, lambda a, b: F.struct(F.get(turns, a)["role"].alias("role"), F.transform(F.slice(turns, a + 1, b - a), lambda t: t["text"]).alias("texts"))
        )

    return let(starts, cut)


def _pieces(blocks: Column, loss_role: str) -> Column:
    """The strings (s, loss) whose concatenation is the formatted conversation."""
    piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
    plain = F.lit(False)

    def of_block(b: Column) -> Column:
        role = F.replace(_escape(b["role"]), F.lit("\n"), F.lit("\\n"))
        texts = F.transform(
            b["texts"], lambda t, i: F.array(piece(F.when(i == 0, F.lit("")).otherwise(F.lit("<seg>")), plain), piece(_escape(t), b["role"] == loss_role))
        )
        return F.concat(F.array(piece(F.concat(F.lit("### "), role, F.lit("\n")), plain)), F.flatten(texts), F.array(piece(F.lit("</turn>\n"), plain)))

    return F.flatten(F.transform(blocks, of_block))


def format_chats(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """``conv_id, formatted, loss_spans`` with spans (start, end) in code points of ``formatted``."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def spans(p: Column, ends: Column) -> Column:
        found = F.transform(p, lambda x, i: F.when(x["loss"], F.struct((F.get(ends, i) - F.length(x["s"])).alias("start"), F.get(ends, i).alias("end"))))
        return F.filter(found, lambda x: x.isNotNull())

    def formatted(p: Column) -> Column:
        lengths = F.transform(p, lambda x: F.length(x["s"]).cast("long"))
        found = let(let(lengths, _running_sums), lambda ends: spans(p, ends))
        return F.struct(F.array_join(F.transform(p, lambda x: x["s"]), "").alias("formatted"), found.alias("loss_spans"))

    pieces = let(F.col("turns"), lambda t: _pieces(_blocks(t), loss_role))
    return sorted_turns.select("conv_id", F.explode(F.array(let(pieces, formatted))).alias("f")).select("conv_id", "f.formatted", "f.loss_spans")


def _cut(text: Column, spans: Column, base: Column, groups: tuple[int, ...] = SPAN_GROUPS) -> Column:
    """The unescaped strings of all ``spans`` of ``text``, which begins at place ``base``.

    Finding a place in a string takes time in proportion to it, so spans are cut out
    of the stretch of their group, and groups out of that of theirs.
    """
    if not groups:
        one = lambda s: _unescape(F.substr(text, (s["start"] - base + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
        return F.array_join(F.transform(spans, one), "")
    grouped = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / groups[0]).cast("int")), lambda k: F.slice(spans, k * groups[0] + 1, F.lit(groups[0]))
    )

    def stretch(v: Column) -> Column:
        first, end = F.get(v, F.lit(0))["start"], F.element_at(v, -1)["end"]
        part = F.struct(F.substr(text, (first - base + 1).cast("int"), (end - first).cast("int")).alias("text"), first.alias("first"), v.alias("spans"))
        return let(part, lambda p: _cut(p["text"], p["spans"], p["first"], groups[1:]))

    return F.when(F.size(spans) == 0, F.lit("")).otherwise(F.array_join(F.transform(grouped, stretch), ""))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text), and ``loss_text``, both read from the formatted text alone and its spans."""
    blocks = F.filter(F.split("formatted", "</turn>\n", -1), lambda b: b != "")

    def turns(b: Column) -> Column:
        head = F.substring_index(b, "\n", 1)
        texts = F.split(F.substr(b, F.length(head) + 2), "<seg>", -1)
        return F.transform(texts, lambda t: F.struct(_unescape(F.substr(head, F.lit(5))).alias("role"), _unescape(t).alias("text")))

    loss = _cut(F.col("formatted"), F.col("loss_spans"), F.lit(0).cast("long"))
    return formatted.withColumns({"turns": F.flatten(F.transform(blocks, turns)), "loss_text": loss})


def chat_digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation with digests of what is read back."""
    back = read_back(formatted)
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.expr(r"sha2(array_join(transform(turns, t -> concat(t.role, '\n', t.text, '\n')), ''), 256)").alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
