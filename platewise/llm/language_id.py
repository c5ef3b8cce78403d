"""Language identification by a linear-chain conditional random field (operator 3).

Every word of a text gets a label (a language).  A word's potentials sum learned
weights of its features: affixes, byte n-grams, and membership in the lexicons of
the languages (words typical of one in the training sample).  Learned transition
weights tie neighbouring words, so that stretches of code-switched text keep
their own labels.  Marginals come from the forward-backward recursions; a text's
language is the one with the largest mean marginal over its words with letters,
and the score is that mean.

*Training.*  The sample is bounded: at most ``TRAIN_DOCS`` different labelled texts outside the
held-out fold, dealt to the languages in turn, of each those of the least hashes (texts of
over ``TRAIN_CHARS`` characters after the others, the shortest first), until
``TRAIN_BUDGET`` characters are full; one text of each language is taken in any case.
Their texts are learned from in whole: they are cut into
stretches, which are shuffled and laid one after another into sequences of
``SEQUENCE`` words (the end of the last one is filled from the first), so that
every word counts and transitions between languages are seen.  The likelihood is
climbed by full-batch Adagrad on the driver.  The sample is sorted, so the field
does not depend on how the table is partitioned.

*Long texts.*  Recursions run over blocks of ``BLOCK`` words at once: the
transition products of all blocks are formed in parallel, boundary vectors pass
from block to block, and the inside of all blocks is filled in in parallel.

Rows: a null text, and one without letters, gets ``und`` and score 0; a null
``lang`` is never learned from; repeated rows are predicted one by one; ties go to
the first language in order; very long texts are predicted in whole, and learned from
in whole where a language has too few others; equal texts of a language are learned from once; with nothing to learn from, every text is ``und``;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.common import U64, Words, materialize, mix64, raw_texts, release, slices

#: Bounds of the training sample: rows, characters in all, and the length up to which texts come first.
TRAIN_DOCS, TRAIN_BUDGET, TRAIN_CHARS = 600, 8_000_000, 100_000
SEQUENCE = 64
FEATURE_BITS, LEXICON_WORDS = 16, 400
EPOCHS, RATE, DECAY = 40, 0.3, 1e-3
BLOCK = 64
SIGNS = b".,;:!?\"'()[]{}<>#*$%&|=+-_/\\`~^@0123456789"
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (hashed) of lower-case words: feature, index of its word; and the words' own hashes."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    buf = np.frombuffer(b"\n" + b"\n".join(words) + b"\n" * 9, np.uint8)
    stops = np.cumsum(sizes + 1)
    starts = stops - sizes
    eight = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    index = np.arange(len(words))
    features, owners = [], []

    def add(kind: int, values: np.ndarray, owner: np.ndarray) -> None:
        features.append(mix64(values + U64(kind << 60)) & U64((1 << FEATURE_BITS) - 1))
        owners.append(owner)

    for kind, width in ((1, 2), (2, 3)):  # n-grams, the line feed standing for the ends of the word
        many = np.maximum(sizes + 3 - width, 0)
        owner = np.repeat(index, many)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts - 1, many)
        add(kind, eight[at] & MASKS[width], owner)
    for width in (2, 3, 4):  # affixes
        long = index[sizes > width]
        add(2 + width, eight[starts[long]] & MASKS[width], long)
        add(6 + width, eight[stops[long] - width] & MASKS[width], long)
    whole = mix64(eight[starts] & MASKS[np.minimum(sizes, 8)])
    long = index[sizes > 8]
    whole[long] = mix64(whole[long] ^ eight[stops[long] - 8] ^ (sizes[long].astype(U64) << U64(32)))
    return np.concatenate(features).astype(np.int64), np.concatenate(owners), whole


def split(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, lower-cased and without signs or digits at their ends; codes of all words; words up to each text's end."""
    lowered = [t.lower() if t.isascii() else t.decode("utf-8").lower().encode("utf-8") for t in texts]
    words = Words(b"\n".join(lowered) + b"\n")
    codes, first = words.distinct()
    ends = np.searchsorted(words.starts, np.cumsum(np.fromiter(map(len, lowered), np.int64, len(texts)) + 1))
    return [w.strip(SIGNS) for w in words.pick(first)], codes, ends


@dataclass
class Field:
    """A trained field: languages, weights of features, lexicon (sorted hashes, language of each), transitions."""

    languages: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    lexicon_of: np.ndarray
    lexicon_weights: np.ndarray
    transitions: np.ndarray

    def potentials(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log potentials of words, and which have letters (others are neutral)."""
        scores = np.zeros((len(words), len(self.languages)))
        lettered = np.fromiter((bool(w) for w in words), bool, len(words))
        if len(words):
            features, owners, whole = word_features(words)
            for k in range(scores.shape[1]):
                scores[:, k] = np.bincount(owners, self.weights[features, k], len(words))
            at = self.in_lexicon(whole)
            scores[at >= 0] += self.lexicon_weights[self.lexicon_of[at[at >= 0]]]
        scores[~lettered] = 0
        return scores, lettered

    def in_lexicon(self, whole: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.full(len(whole), -1)
        at = np.minimum(np.searchsorted(self.lexicon, whole), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == whole, at, -1)


def marginals(e: np.ndarray, sizes: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Posterior label probabilities of words of sequences that lie one after another.

    ``e`` are potentials (words x labels), ``a`` transition potentials.
    """
    labels = e.shape[1]
    blocks = -(-sizes // BLOCK)
    total = int(blocks.sum())
    if not total:
        return e
    # words into blocks; places past a sequence's end stay neutral
    begins = np.cumsum(blocks) - blocks
    offsets = np.arange(len(e)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.repeat(begins * BLOCK, sizes) + offsets
    padded = np.ones((total * BLOCK, labels))
    padded[place] = e
    inside = np.zeros(total * BLOCK, bool)
    inside[place] = True
    padded, inside = padded.reshape(total, BLOCK, labels), inside.reshape(total, BLOCK)
    product = np.tile(np.eye(labels), (total, 1, 1))
    for t in range(BLOCK):
        step = (product @ a) * padded[:, t, None, :]
        step /= step.sum(axis=(1, 2), keepdims=True)
        product = np.where(inside[:, t, None, None], step, product)
    enter, leave = np.full((total, labels), 1 / labels), np.full((total, labels), 1 / labels)
    most = int(blocks.max())
    for k in range(1, most):
        b = begins[blocks > k] + k
        v = np.einsum("bi,bij->bj", enter[b - 1], product[b - 1])
        enter[b] = v / v.sum(axis=1, keepdims=True)
    last = begins + blocks - 1
    for k in range(1, most):
        b = last[blocks > k] - k
        v = np.einsum("bij,bj->bi", product[b + 1], leave[b + 1])
        leave[b] = v / v.sum(axis=1, keepdims=True)
    alpha = np.empty_like(padded)
    v = enter
    for t in range(BLOCK):
        step = (v @ a) * padded[:, t]
        step /= step.sum(axis=1, keepdims=True)
        v = np.where(inside[:, t, None], step, v)
        alpha[:, t] = v
    v = leave
    for t in range(BLOCK - 1, -1, -1):
        alpha[:, t] *= v
        step = (padded[:, t] * v) @ a.T
        step /= step.sum(axis=1, keepdims=True)
        v = np.where(inside[:, t, None], step, v)
    found = alpha.reshape(total * BLOCK, labels)[place]
    return found / found.sum(axis=1, keepdims=True)


def train(samples: list[tuple[str, str]], seed: int = 7) -> Field:
    """Fit a field to ``(text, language)`` pairs."""
    languages = sorted({y for _, y in samples})
    rng = np.random.default_rng(seed)
    words, codes, ends = split([t.encode("utf-8") for t, _ in samples])
    gold_of = np.array([languages.index(y) for _, y in samples])
    bounds = np.concatenate([[0], ends])
    label_count, sets = len(languages), len(samples)
    features, owners, whole = word_features(words)
    # lexicons: words whose share in one language is far above that in the others
    by_word: list[Counter] = [Counter() for _ in languages]
    for k in range(sets):
        by_word[gold_of[k]].update(codes[bounds[k] : bounds[k + 1]].tolist())
    sums = np.array([max(1, sum(c.values())) for c in by_word])
    table: dict[int, int] = {}
    for k, counts in enumerate(by_word):
        typical = [w for w, n in counts.most_common(4 * LEXICON_WORDS) if words[w] and n / sums[k] > 3 * max([c[w] / s for j, (c, s) in enumerate(zip(by_word, sums)) if j != k], default=0)]
        table |= {int(whole[w]): k for w in typical[:LEXICON_WORDS]}
    lexicon = np.array(sorted(table), U64)
    field = Field(languages, np.zeros((1 << FEATURE_BITS, label_count)), lexicon, np.array([table[int(x)] for x in lexicon], np.int64), np.zeros((label_count, label_count)), np.zeros((label_count, label_count)))
    lettered = np.fromiter((bool(w) for w in words), bool, len(words))
    in_lexicon = field.in_lexicon(whole)
    rows, gold = sequences([codes[bounds[k] : bounds[k + 1]] for k in range(sets)], gold_of, rng)
    if not len(rows):
        return field
    hot = np.eye(label_count)[gold]
    pair_gold = np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:])
    squares = [np.full(x.shape, 1e-6) for x in (field.weights, field.lexicon_weights, field.transitions)]
    for _ in range(EPOCHS):
        slope, pair_slope = gradient(field.potentials(words)[0], field.transitions, rows, hot, pair_gold)
        by_code = np.stack([np.bincount(rows.ravel(), slope[:, :, k].ravel(), len(words)) for k in range(label_count)], axis=1)
        by_code[~lettered] = 0
        per = len(rows)
        steps = [
            np.stack([np.bincount(features, by_code[owners, k], 1 << FEATURE_BITS) for k in range(label_count)], axis=1) / per - DECAY * field.weights,
            np.stack([by_code[(in_lexicon >= 0) & (field.lexicon_of[in_lexicon] == k)].sum(axis=0) if len(lexicon) else np.zeros(label_count) for k in range(label_count)]) / per - DECAY * field.lexicon_weights,
            pair_slope / per - DECAY * field.transitions,
        ]
        for x, g, s in zip((field.weights, field.lexicon_weights, field.transitions), steps, squares):
            s += g * g
            x += RATE * g / np.sqrt(s)
    return field


def sequences(texts: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Word codes and gold labels (sequences x ``SEQUENCE``): every word of every text, in shuffled stretches."""
    stretches = []
    for k, own in enumerate(texts):
        at = 0
        while at < len(own):  # every second text in stretches of any length
            size = SEQUENCE if k % 2 else int(rng.integers(1, SEQUENCE + 1))
            stretches.append((own[at : at + size], labels[k]))
            at += size
    if not stretches:
        return np.zeros((0, SEQUENCE), np.int64), np.zeros((0, SEQUENCE), np.int64)
    order = [stretches[k] for k in rng.permutation(len(stretches))]
    stream, marks = np.concatenate([x for x, _ in order]), np.concatenate([np.full(len(x), y) for x, y in order])
    places = np.arange(-(-len(stream) // SEQUENCE) * SEQUENCE).reshape(-1, SEQUENCE) % len(stream)
    return stream[places], marks[places]


def log_likelihood(scores: np.ndarray, transitions: np.ndarray, rows: np.ndarray, gold: np.ndarray) -> float:
    """Log probability of gold labels, the label before a sequence being any; for comparison in tests."""
    total, labels = 0.0, scores.shape[1]
    for codes, marks in zip(rows, gold):
        v = np.full(labels, 1 / labels)
        path = scores[codes, marks].sum() + transitions[marks[:-1], marks[1:]].sum() + np.log(np.exp(transitions)[:, marks[0]].sum() / labels)
        log_z = 0.0
        for c in codes:
            v = (v @ np.exp(transitions)) * np.exp(scores[c])
            log_z += np.log(v.sum())
            v /= v.sum()
        total += path - log_z
    return total


def gradient(scores: np.ndarray, transitions: np.ndarray, rows: np.ndarray, hot: np.ndarray, pair_gold: np.ndarray, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Gold minus expected labels of every word (sequences x words x labels), and of neighbours (labels x labels)."""
    labels = scores.shape[1]
    potentials, a = np.exp(scores - scores.max(axis=1, keepdims=True)), np.exp(transitions)
    post, pairs = np.empty(hot.shape), np.zeros((labels, labels))
    for at in range(0, len(rows), block):
        e = potentials[rows[at : at + block]]
        alpha, beta = np.empty_like(e), np.empty_like(e)
        v = np.full((len(e), labels), 1 / labels)
        for t in range(e.shape[1]):
            v = (v @ a) * e[:, t]
            v /= v.sum(axis=1, keepdims=True)
            alpha[:, t] = v
        v = np.ones((len(e), labels))
        for t in range(e.shape[1] - 1, -1, -1):
            beta[:, t] = v
            v = (e[:, t] * v) @ a.T
            v /= v.sum(axis=1, keepdims=True)
        found = alpha * beta
        post[at : at + block] = found / found.sum(axis=2, keepdims=True)
        both = alpha[:, :-1, :, None] * a * (e * beta)[:, 1:, None, :]
        pairs += (both / both.sum(axis=(2, 3), keepdims=True)).sum(axis=(0, 1))
    return hot - post, pair_gold - pairs


def training_sample(docs: DataFrame, limit: int = TRAIN_DOCS, chars: int = TRAIN_CHARS, budget: int = TRAIN_BUDGET) -> list[tuple[str, str]]:
    """At most ``limit`` labelled whole texts from outside the held-out fold, the same in any partitioning (see the module)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    size = F.length("text")
    keys = rows.select("lang", F.xxhash64("text", F.lit(17)).alias("h"), size.alias("size"), F.greatest(size - chars, F.lit(0)).alias("beyond"))
    keys = materialize(keys.distinct().withColumn("long", F.col("beyond") > 0), "keys")
    # about four times as many of a language as are wanted go into the choice of the least hashes
    counts = keys.groupBy("lang", "long").agg(F.count("*").alias("n"))
    near = keys.join(counts, ["lang", "long"]).where(F.pmod(F.xxhash64("h", F.lit(18)), F.col("n")) < 4 * limit)
    first = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("beyond", "h")))
    chosen, total = {}, 0
    for r in first.orderBy("rank", "lang").limit(limit).collect():
        if r["rank"] == 1 or total + r["size"] <= budget:
            chosen[r["lang"], r["h"]] = r["rank"]
            total += r["size"]
    release(keys)
    if not chosen:
        return []
    wanted = docs.sparkSession.createDataFrame([(lang, h) for lang, h in chosen], "lang string, h long")
    texts = rows.withColumn("h", F.xxhash64("text", F.lit(17))).join(F.broadcast(wanted), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    return [(r["text"], r["lang"]) for r in sorted(texts.collect(), key=lambda r: (chosen[r["lang"], r["h"]], r["lang"]))]


def predict(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        a = np.exp(field.transitions)
        for batch in batches:
            texts, known = raw_texts(batch.column(1)), np.array(batch.column(3).to_pylist(), bool)
            langs: list[str] = []
            scores: list[float] = []
            for lo, hi in slices(texts, 3_000_000):
                words, codes, ends = split(texts[lo:hi])
                sizes = np.diff(np.concatenate([[0], ends]))
                mean = np.zeros((hi - lo, max(1, len(field.languages))))
                if len(codes) and field.languages:
                    potentials, lettered = field.potentials(words)
                    e = np.exp(potentials - potentials.max(axis=1, keepdims=True))
                    post = marginals(e[codes], sizes, a) * lettered[codes][:, None]
                    sums = np.concatenate([np.zeros((1, post.shape[1])), np.cumsum(post, axis=0)])
                    mean = sums[ends] - sums[ends - sizes]
                    mean /= np.maximum(mean.sum(axis=1, keepdims=True), 1e-12)
                best = mean.argmax(axis=1)
                for k, b in enumerate(best.tolist()):
                    sure = bool(field.languages) and known[lo + k] and mean[k, b] > 0
                    langs.append(field.languages[b] if sure else "und")
                    scores.append(round(min(1.0, float(mean[k, b])), 9) if sure else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("known"))
    return plain.mapInArrow(label, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Train on a bounded sample of the rows outside the held-out fold and predict every row."""
    sample = training_sample(docs)
    nothing = np.zeros((0, 0))
    field = train(sample) if sample else Field([], nothing, np.zeros(0, U64), np.zeros(0, np.int64), nothing, nothing)
    return predict(docs, field)
