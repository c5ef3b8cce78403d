r"""How five text filters interact, whatever their order (operator 13).

Each document gets a mask of the filters it fails, by Spark expressions alone:

* A: under 200 words (maximal runs of ``[^\x20\x09-\x0D]``);
* B: distinct words (case-sensitive) under half of the words;
* C: over 3 % of the code points are ``[A-Z]``;
* D: holds any of ``#$%&*|``;
* E: its text is the text of a smaller ``doc_id`` anywhere in the table.

For E, texts are grouped by their SHA-256 digest, with partial aggregation, to the
least ``doc_id`` of each; a document fails unless it is that one, which is a join on
``doc_id`` and digest, so a text that a third of the rows share is no hot key.  Masks
are counted as 32 cells for each part, and all orders are enumerated from the cells:
the result takes 600 rows a part from at most 32, whatever the number of documents.

Rows: a null text counts as empty, and equals an empty one; a null or empty ``lang`` is
the part with the empty name; very long texts are judged in whole; rows that repeat a
``doc_id`` are judged one by one, and those that share the least id of a text pass E; a
null ``doc_id`` is neither smaller nor larger than another, so it passes E, and no label
belongs to it; repeated labels of an id count once, and a null label is no label; an
empty table gives an empty result; other columns are ignored, even where their names clash.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import materialize

BLANKS = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
SIGNS = "[#$%&*|]"
#: The bit of a mask that filter E takes, above those of the filters on the text alone.
REPEATED = 1 << FILTERS.index("E")
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, BLANKS, -1), "")
    counted = F.struct(F.size(words).cast("long").alias("n"), F.size(F.array_distinct(words)).cast("long").alias("distinct"))
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    fails = [
        counted["n"] < LEAST_WORDS,
        100 * counted["distinct"] < DISTINCT_PERCENT * counted["n"],
        100 * capitals > CAPITAL_PERCENT * F.length(text).cast("long"),
        text.rlike(SIGNS),
    ]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0)).cast("int")


def masked(docs: DataFrame) -> DataFrame:
    """``doc_id, part, digest, mask`` of every row, without filter E."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), text_mask(F.col("text")).alias("mask"))


def cells(marks: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the set of filters they fail; ``marks`` as ``masked`` gives them."""
    first = marks.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    rows = marks.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    joined = rows.join(first, ["doc_id", "digest"], "left").join(flags, "doc_id", "left")
    repeated = F.col("first").isNull() & F.col("doc_id").isNotNull()
    mask = F.col("mask") + F.when(repeated, REPEATED).otherwise(0)
    with_flag = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return joined.groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("n"), with_flag("good"), with_flag("toxic"))


def by_order(found: DataFrame) -> DataFrame:
    """The counts of every order and step of the filters, from the cells of each part."""
    bits = F.transform(F.split("filter_order", ""), lambda x: F.pow(F.lit(2), F.ascii(x) - ord("A")).cast("int"))
    steps = found.withColumn("filter_order", F.explode(F.lit(ORDERS))).withColumn("bits", bits).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    before = F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, b: a + b)
    steps = steps.withColumns({"bit": F.element_at("bits", F.col("step")), "before": before})
    mask, n = F.col("mask"), F.col("n")
    fails = mask.bitwiseAND(F.col("bit")) != 0
    reached = mask.bitwiseAND(F.col("before")) == 0
    share = F.lit(len(ORDERS)) / F.greatest(F.bit_count(mask), F.lit(1))  # the orders in which one filter of a cell comes first
    total = lambda when, value, name: F.sum(F.when(when, value).otherwise(0)).cast("long").alias(name)
    return steps.groupBy("part", "filter_order", "step").agg(
        total(reached & ~fails, n, "kept"),
        total(reached & fails, n, "removed"),
        total(~reached & fails, n, "redundant"),
        total(mask == F.col("bit"), n, "unique_fails"),
        total(reached & fails, F.col("good"), "good_lost"),
        total(reached & fails, F.col("toxic"), "toxic_lost"),
        total(fails, n * share.cast("long"), "shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step`` with the counts of each order and step."""
    return by_order(cells(materialize(masked(docs), "masks"), labels))
