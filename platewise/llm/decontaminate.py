"""Benchmark decontamination by CGK embedding and bit sampling (operator 7).

A document is contaminated by an item if one of its item-sized windows (as many
words as the item has) is within ``percent`` of that many word edits of the item.
Words are compared lower-cased and without signs at their ends.

*Embedding.*  The CGK walk reads a word sequence with a pointer and writes the
word under it at each of ``3 n`` steps; a random bit of the step and the word
says whether the pointer moves on.  Sequences a few edits apart fall back into
step after each edit, so their edit distance becomes a Hamming distance.
*Sampling.*  Each of several independent walks is sampled several times at
``DRAWS`` steps; a window and an item that agree on one sample are candidates.  The
share of agreeing steps falls with the item's size (at the threshold 0.55 at 20
words, 0.43 at 59, 0.32 at 120, 0.23 at 300, 0.17 at 600), so walks and samples grow
with it (``rounds``).  With these shares the chance of a miss at the threshold,
``(1 - share**DRAWS)**samples`` over all walks, is below 1 in 100,000 at each of the
sizes simulated (16, 32, 59, 65, 120, 320, 321 and 1,000 words).  Of simulated
windows at the threshold, 30 of 2,000 words and 12 of 4,000, none was missed.
*Verification.*  Candidates are confirmed by their exact word edit distance.

Before the embedding, windows that cannot be within the threshold are passed
over: ``e`` edits leave at least ``n - 1 - 2 e`` of an item's ``n - 1`` word
pairs and ``n - e`` of its words in the window, so a window with fewer pairs or
words of the items of its size is out, as is one with over ``e`` distinct words
less than any of them, and so is a candidate with fewer words of its item
(lossless).
Items too short to have such a bound, and of one word, are compared at every
window.

The items are the query set: they are taken in blocks of ``BLOCK_BYTES`` of text,
each a broadcast of its own, and a task holds the index of one block at a time,
so its memory is bounded whatever the number of items.  Up to ``PASS_BLOCKS``
blocks meet the documents in one pass: a task sets aside ``BUFFER_BYTES`` of
texts and searches them with one block after another.  Documents are never shuffled.

Rows: null or wordless items match nothing; null texts have no window; very long
texts are searched in whole; repeated items are told apart by id, and rows of one
item id give one row with the best of their matches, or one for each block that
holds some of them; of windows with the
same distance the first counts; repeated rows are searched one by one; an empty
table gives an empty result; other columns are ignored by ``find_leaks`` and kept
by ``drop_leaks``, where all rows of an id go if one of them matches, and a row with a null
id goes by its own text (it is known by a 64-bit hash of the text).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import U64, WordHashes, Words, mix64, raw_texts, slices

#: Word edits allowed, in percent of the item's words.
PERCENT = 20
DRAWS = 2
BLOCK_BYTES = 4_000_000
PASS_BLOCKS, BUFFER_BYTES = 16, 32_000_000
PAIR_BITS = 20
SIGNS = b".,;:!?\"'()[]{}<>#*$%&|=+-_/\\`~^@"
HIT = "doc_id long, item_id long, start long, n_words long, distance long"


class Normalised(WordHashes):
    """Word bytes -> hash of the word without signs at its ends (a word of signs: of itself)."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.strip(SIGNS) or word)
        return value


def word_codes(texts: list[bytes], memo: Normalised) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and how many words the texts have up to each end."""
    lowered = [t.lower() if t.isascii() else t.decode("utf-8").lower().encode("utf-8") for t in texts]
    words = Words(b"\n".join(lowered) + b"\n")
    codes, first = words.distinct()
    values = np.fromiter((memo[w] for w in words.pick(first)), U64, len(first))
    ends = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(texts)) + 1)
    return values[codes] if len(first) else np.zeros(0, U64), np.searchsorted(words.starts, ends)


def walk(windows: np.ndarray, seed: int) -> np.ndarray:
    """CGK embeddings (windows x 3 n) of equally long sequences; 0 where the pointer has left the sequence."""
    count, n = windows.shape
    padded = np.concatenate([windows, np.zeros((count, 1), U64)], axis=1)
    bits = mix64(padded + U64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1)))
    out = np.empty((count, 3 * n), U64)
    at, rows = np.zeros(count, np.int64), np.arange(count)
    for step in range(3 * n):
        if step and step % 64 == 0:
            bits = mix64(bits + U64(step))
        out[:, step] = padded[rows, at]
        at = np.minimum(at + ((bits[rows, at] >> U64(step % 64)) & U64(1)).astype(np.int64), n)
    return out


def rounds(n: int) -> tuple[int, int]:
    """Walks, and samples of each, for sequences of ``n`` words."""
    if n < 60:
        return 12, 12
    return 24 if n <= 320 else 48, 16 * -(-n // 160)


def sample_steps(n: int) -> np.ndarray:
    """Steps (walks x samples x draws) that are compared; from the first two thirds, where the pointer is inside."""
    rng = np.random.default_rng(n)
    return rng.integers(0, max(1, 2 * n - n // 4), (*rounds(n), DRAWS))


def sample_keys(windows: np.ndarray) -> np.ndarray:
    """Keys (windows x walks * samples) of equally long sequences."""
    steps = sample_steps(windows.shape[1])
    walks, samples, _ = steps.shape
    keys = []
    for w in range(walks):
        embedded = walk(windows, w)
        for s in range(samples):
            h = np.full(len(windows), w * samples + s + 1, U64)
            for d in range(DRAWS):
                h = mix64(h * U64(0x9E3779B97F4A7C15) + embedded[:, steps[w, s, d]])
            keys.append(h)
    return np.stack(keys, axis=1)


def edit_distance(a: list, b: list, most: int) -> int:
    """Word edit distance of two sequences, or ``most + 1`` if it is larger (bit-parallel)."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    peq: dict = defaultdict(int)
    for k, x in enumerate(a):
        peq[x] |= 1 << k
    mask, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pv, mv, score = mask, 0, len(a)
    for x in b:
        eq = peq.get(x, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) | 1, mh << 1
        pv, mv = (mh | ~(xv | ph)) & mask, ph & xv & mask
    return min(score, most + 1)


class ItemIndex:
    """Bit-sampling tables of a block of items."""

    def __init__(self, items: list[tuple[int, bytes]], percent: int = PERCENT):
        codes, ends = word_codes([t for _, t in items], Normalised())
        self.percent = percent
        self.by_size: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
        for (item_id, _), a, b in zip(items, np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
            if b > a:
                self.by_size[b - a].append((item_id, codes[a:b].tolist()))
        #: For each hashed word pair, in bits, the sizes (modulo 64 in order) of the items that hold it.
        self.pairs = np.zeros(1 << PAIR_BITS, U64)
        self.varied = {n: min(len(set(c)) for _, c in same) for n, same in self.by_size.items()}
        self.words = np.zeros(1 << PAIR_BITS, U64)  # the same for words
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, (n, same) in enumerate(sorted(self.by_size.items())):
            rows = np.array([c for _, c in same], U64)
            self.pairs[self.pair_codes(rows[:, :-1], rows[:, 1:]).ravel()] |= U64(1 << k % 64)
            self.words[self.word_codes(rows).ravel()] |= U64(1 << k % 64)
            keys = sample_keys(rows)
            order = np.argsort(keys.ravel(), kind="stable")
            self.tables[n] = keys.ravel()[order], order // keys.shape[1]

    @staticmethod
    def word_codes(a: np.ndarray) -> np.ndarray:
        return (a & U64((1 << PAIR_BITS) - 1)).astype(np.int64)

    @staticmethod
    def pair_codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (mix64(a * U64(0x9E3779B97F4A7C15) + b) & U64((1 << PAIR_BITS) - 1)).astype(np.int64)

    def most(self, n: int) -> int:
        return n * self.percent // 100

    def search(self, codes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """``(text, item, start, n, distance)`` of the best window of every text and item that match."""
        if not len(codes) or not self.by_size:
            return
        held = self.pairs[self.pair_codes(codes[:-1], codes[1:])]
        at_pair = np.nonzero(held)[0]
        held = held[at_pair]
        text_of = np.searchsorted(ends, np.arange(len(codes)), side="right")
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for k, (n, same) in enumerate(sorted(self.by_size.items())):
            if n > len(codes):
                continue
            need = n - 1 - 2 * self.most(n)
            if need > 0:
                own = at_pair[held & U64(1 << k % 64) != 0]
                if len(own) < need:
                    continue
                # starts whose window holds the pairs j to j + need - 1
                lo, hi = np.maximum(own[need - 1 :] - (n - 2), 0), np.minimum(own[: len(own) - need + 1], len(codes) - n)
                width = np.maximum(hi - lo + 1, 0)
                starts = np.unique(np.repeat(lo - np.cumsum(width) + width, width) + np.arange(width.sum()))
            else:
                starts = np.arange(len(codes) - n + 1)
            starts = starts[text_of[starts] == text_of[starts + n - 1]]
            sorted_keys, owners = self.tables[n]
            step = max(64, min(20_000, 1_200_000 // n))
            for first in range(0, len(starts), step):
                part = starts[first : first + step]
                windows = codes[part[:, None] + np.arange(n)]
                ranked = np.sort(windows, axis=1)
                varied = (ranked[:, 1:] != ranked[:, :-1]).sum(axis=1) + 1 >= self.varied[n] - self.most(n)
                enough = varied & ((self.words[self.word_codes(windows)] & U64(1 << k % 64) != 0).sum(axis=1) >= n - self.most(n))
                part, windows = part[enough], windows[enough]
                keys = sample_keys(windows)
                lo, hi = np.searchsorted(sorted_keys, keys), np.searchsorted(sorted_keys, keys, side="right")
                met: Counter[tuple[int, int]] = Counter()
                for i, j in zip(*np.nonzero(hi > lo)):
                    met.update((int(i), int(o)) for o in owners[lo[i, j] : hi[i, j]])
                for (i, o), _ in sorted(met.items(), key=lambda x: (-x[1], x[0])):
                    item_id, item = same[o]
                    at = int(part[i])
                    text = int(text_of[at])
                    if best.get((text, item_id), (1, 0, 0))[0] == 0:
                        continue  # an exact copy is already found
                    window = windows[i].tolist()
                    present = set(window)
                    if sum(x in present for x in item) < n - self.most(n):
                        continue
                    distance = 0 if item == window else edit_distance(item, window, self.most(n))
                    if distance <= self.most(n):
                        found = (distance, at - (int(ends[text - 1]) if text else 0), n)
                        if found < best.get((text, item_id), (n + 1, 0, 0)):
                            best[text, item_id] = found
        for (text, item_id), (distance, start, n) in sorted(best.items()):
            yield text, item_id, start, n, distance


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """The items with text, streamed to the driver one bounded block at a time, in order of id."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        text = row.text.encode("utf-8")
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row.item_id, text))
        size += len(text)
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES, pass_blocks: int = PASS_BLOCKS, buffer_bytes: int = BUFFER_BYTES) -> DataFrame:
    """``doc_id, item_id, start, n_words, distance``: the best window of every document and item that match."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    context = docs.sparkSession.sparkContext
    found = None
    blocks = item_blocks(benchmark, block_bytes)
    while shared := [context.broadcast(items) for items in islice(blocks, pass_blocks)]:

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            memo = Normalised()
            index = ItemIndex(shared[0].value, percent) if len(shared) == 1 else None

            def hits(ids: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
                for block in shared:
                    own, rows = index or ItemIndex(block.value, percent), []
                    for a, b in slices(texts):
                        rows += [(ids[a + t], *rest) for t, *rest in own.search(*word_codes(texts[a:b], memo))]
                    columns = list(zip(*rows)) or [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in HIT.split(", ")])

            ids: list = []
            texts: list[bytes] = []
            size = 0
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                    ids.append(doc_id)
                    texts.append(text)
                    size += len(text)
                    if size >= buffer_bytes:
                        yield from hits(ids, texts)
                        ids, texts, size = [], [], 0
            if texts:
                yield from hits(ids, texts)

        part = plain.mapInArrow(search, HIT)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], HIT)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose document matches no item."""
    own = F.col("doc_id").cast("long")
    keyed = docs.withColumn("_row", F.struct(*docs.columns)).select("_row", F.coalesce(own, F.xxhash64("text")).alias("doc_id"), "text")
    leaked = find_leaks(keyed, benchmark, percent).select("doc_id").distinct()
    return keyed.join(leaked, "doc_id", "left_anti").select("_row.*")
