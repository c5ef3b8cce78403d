r"""Document quality by rules and a hashed n-gram likelihood ratio, with Spark expressions only (operator 2).

Base rules count words, symbols, repeated lines and words in repeated 8-word
windows.  The method's verdict is a log-likelihood ratio: unigrams and bigrams of
letter runs and sign runs are hashed into ``BUCKETS`` buckets; one multinomial is
estimated from trusted documents, another from the whole corpus; the score of a
document is the mean over its n-grams of ``log(p_trusted / p_corpus)``.  A
document is kept if its score is at least ``THRESHOLD`` and no base rule fails.

The corpus multinomial counts every document.  The trusted one is fitted on at
most ``TRUSTED_DOCS`` documents labelled good (those whose hashed ids are least),
so that their ids may be broadcast.  Both are one table of ``BUCKETS`` rows at
most, whatever the input.

Rows: null text has no words; such a document, as any of under 20 words, fails
the base rules; a document without n-grams scores 0; a label for an unknown or a
null id has no effect and repeated labels count once; repeated rows are counted
and judged one by one; very long texts are counted and judged in whole; a score
equal to the threshold is kept; of ids with one hash the least come first into
the trusted sample; without labelled rows every score is 0; an empty table gives
an empty result; other columns are kept by ``keep_good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
#: Bound of the sample of labelled documents that the trusted multinomial is fitted on.
TRUSTED_DOCS = 20_000
#: Pseudo-n-grams, drawn from the corpus multinomial, that the trusted one starts from; few
#: trusted documents therefore leave all scores near 0.
PRIOR = float(BUCKETS)
#: Documents that score less are rejected.
THRESHOLD = -0.5
#: Words in a window whose repetition counts, and limits of the base rules.
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 8, 20, 30
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _pairs(a: Column, gap: int, n: Column) -> Column:
    """Hashes of elements ``gap`` apart; ``n`` is how many there are."""
    m = F.greatest(n - gap, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), m), F.slice(a, F.lit(gap + 1), m), lambda x, y: F.xxhash64(x, y))


def _repeat_words(words: Column) -> Column:
    """Words inside windows of 8 that occur twice or more."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    twos = let(hashes, lambda h: _pairs(h, 1, F.size(h)))
    fours = let(twos, lambda h: _pairs(h, 2, F.size(h)))
    eights = let(fours, lambda h: _pairs(h, 4, F.size(h)))

    def covered(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            m = F.size(s) - 1
            twins = F.zip_with(F.slice(s, F.lit(1), m), F.slice(s, F.lit(2), m), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
            return F.array_sort(F.array_distinct(F.flatten(twins)))

        total = F.aggregate(
            let(ranked, places),
            F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")),
            lambda a, i: F.struct((i + WINDOW).alias("upto"), (a["n"] + i + WINDOW - F.greatest(i, a["upto"])).alias("n")),
            lambda a: a["n"],
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(total)

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(eights, covered)).cast("long")


def base_rules(text: Column) -> dict[str, Column]:
    """Columns of the base rules for a text (null: empty)."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return {
        "words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def ngram_buckets(text: Column) -> Column:
    """Buckets of the unigrams and bigrams of a text, with repeats."""
    tokens = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))
    return F.transform(let(tokens, lambda h: F.concat(h, _pairs(h, 1, F.size(h)))), lambda x: x.bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_DOCS) -> DataFrame:
    """At most ``limit`` ids of documents labelled good, the same whatever the partitioning."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("trusted_id")).distinct()
    return good.orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(limit)


def ratio_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row with ``ratios``: the log ratio of every bucket, in order."""
    grams = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(trusted_ids(labels)), F.col("doc_id") == F.col("trusted_id"), "left")
        .select(F.explode(ngram_buckets(F.col("text"))).alias("bucket"), F.col("trusted_id").isNotNull().cast("int").alias("trusted"))
    )
    counts = grams.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("trusted").alias("t"))
    totals = counts.agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", F.struct("n", "t")))).alias("by"),
        F.sum("n").alias("all_n"),
        F.sum("t").alias("all_t"),
    )

    def log_ratio(x: Column) -> Column:
        share = x["n"] / F.col("all_n")
        return F.coalesce(F.log((x["t"] + PRIOR * share) / (F.col("all_t") + PRIOR) / share), F.lit(0.0))

    ratio = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: let(F.col("by")[b], log_ratio))
    return totals.select(F.when(F.col("all_t") > 0, ratio).otherwise(F.array_repeat(F.lit(0.0), BUCKETS)).alias("ratios"))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with the base columns, ``score`` and ``kept``.

    All of them come out of a generator, which the optimiser neither repeats nor
    moves a filter through, so that a text is taken apart once.
    """
    rules = base_rules(F.col("text"))
    words = rules.pop("words")
    score = let(
        F.struct(ngram_buckets(F.col("text")).alias("grams"), F.col("_ratios").alias("ratios")),
        lambda v: F.aggregate(v["grams"], F.lit(0.0), lambda a, b: a + F.get(v["ratios"], b)) / F.greatest(F.size(v["grams"]), F.lit(1)),
    )
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    whole = F.struct(counted.alias("w"), *(c.alias(k) for k, c in rules.items()), score.alias("score"))
    own = docs.columns
    ratios = ratio_table(docs, labels).scalar()
    found = docs.withColumn("_ratios", ratios).select(*own, F.explode(F.array(whole)).alias("_v"))
    fields = [F.col("_v.w.n_words"), F.col("_v.w.n_repeat_words"), *(F.col(f"_v.{k}") for k in rules), F.col("_v.score")]
    found = found.select(*(c for c in own if c not in {*rules, "n_words", "n_repeat_words", "score"}), *fields)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    clashes = docs.select(*(F.col(c).alias(c) for c in docs.columns if c in ("doc_id", "text")), F.struct(*docs.columns).alias("_row"))
    return judge(clashes, labels).where("kept").select("_row.*")


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = judge(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))
