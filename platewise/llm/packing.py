"""Order-preserving packing of documents into token sequences (operator 9).

Documents keep their order.  The token stream of a task's rows is cut into
windows of at most ``max_len`` tokens by dynamic programming over candidate cuts.
A window costs its padding; a cut inside a document costs a truncation penalty:
little at the end of a sentence (a word that ends in a stop, perhaps with closing
signs, or the last word of a line), much inside one, so that a sentence is cut
only where that saves more padding than ``INNER_CUT`` tokens.  With
``best[j] = cut[j] + max_len - pos[j] + min(best[i] + pos[i])`` over the ``i`` at
most ``max_len`` tokens back, the minimum slides with ``j`` and a monotone queue
gives it in constant time.

A window is padded to ``max_len`` unless its length is a power of two.  The rest
of a task's stream, shorter than a window, is cut by the same costs with that
exemption (``tail_cuts``).

The stream is solved in blocks of about ``BLOCK_TOKENS`` tokens; the last window
of a block is carried into the next.  Memory is one block, or one document where
that is longer.  A lost task is recomputed from its own rows with the same
result: sequence ids are the task's partition number and a counter.

Rows: null text counts as empty; an empty document is its end token alone;
repeated rows and ids are packed one by one; an empty table gives no pieces;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import Words, raw_texts, slices

#: Tokens a sequence holds at most.
MAX_LEN = 4096
#: The id that ends each document.
END_ID = 2
#: Cost, in tokens of padding, of a cut at a sentence end and within a sentence.
SENTENCE_CUT, INNER_CUT = 4, 128
#: Cuts within a sentence are considered at multiples of this from its start.
INNER_STEP = 16
#: Bytes that end a sentence, and that may follow them.
STOPS, CLOSING = list(b".!?"), list(b"\"')]")
BLOCK_TOKENS = 1_000_000
MEMO_LIMIT = 800_000

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


#: Lower-case letters that lower-casing and NFC leave alone, then signs that the pre-tokenizer keeps together.
SIMPLE = re.compile("([a-zß-öø-ÿ]+)([.,;:!?#*$%&|<>()+=_@/-]*)")


class WordIds(dict):
    """Blank-free word -> its ids as little-endian unsigned 32-bit bytes.

    The vocabulary's pre-tokenizer drops white space and never joins characters
    across it, so the encoding of a text is that of its words in order; it also
    parts letters from signs and ignores case, so words that differ in these
    share the ids of their letters, for which the library's model is asked
    directly.  A memo past ``limit`` starts afresh.
    """

    def __init__(self, tokenizer, limit: int = MEMO_LIMIT):
        from tokenizers import pre_tokenizers

        super().__init__()
        self.tokenizer, self.limit, self.runs = tokenizer, limit, {}
        self.model, self.as_bytes = tokenizer.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def run(self, text: str) -> bytes:
        """Ids of a run of lower-case letters or of signs."""
        value = self.runs.get(text)
        if value is None:
            if len(self.runs) >= self.limit:
                self.runs.clear()
            plain = text if text.isascii() else self.as_bytes.pre_tokenize_str(text)[0][0]
            value = self.runs[text] = np.asarray([t.id for t in self.model.tokenize(plain)], "<u4").tobytes()
        return value

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        text = word.decode("utf-8")
        if found := SIMPLE.fullmatch(text.lower()) if len(text) <= 64 and text.isprintable() and max(text) < "\u0100" else None:
            letters, signs = found.groups()
            value = self.run(letters) + (self.run(signs) if signs else b"")
        else:
            value = np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= 64:
            self[word] = value
        return value


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str | None = None) -> WordIds:
    """The word encoder of a tokenizer file, one a worker process."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    found = _LOADED.get(path)
    if found is None:
        from tokenizers import Tokenizer

        found = _LOADED[path] = WordIds(Tokenizer.from_file(path))
    return found


def encode(texts: list[bytes], memo: WordIds, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the documents in a row, each with its end token; tokens of each; offsets just after sentences."""
    raw = b"\n".join(texts) + b"\n"
    if b"<|" not in raw:  # added tokens are matched before lower-casing
        raw = raw.lower()
    words = Words(raw)
    codes, first = words.distinct()
    values = [memo[w] for w in words.pick(first)] + [int(end_id).to_bytes(4, "little")]
    flat = np.frombuffer(b"".join(values), "<u4")
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
    places = np.cumsum(sizes) - sizes
    signs = np.frombuffer(raw, np.uint8)
    last = signs[words.stops - 1]
    inner = np.isin(last, CLOSING) & (words.stops - words.starts > 1)
    last = np.where(inner, signs[np.maximum(words.stops - 2, 0)], last)
    lines = np.cumsum(signs == 10)
    turn = np.append(lines[words.starts[1:]] > lines[words.stops[:-1] - 1], False) if len(words.starts) else np.zeros(0, bool)
    stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    upto = np.searchsorted(words.starts, stops)  # words of the documents so far
    codes = np.insert(codes, upto, len(values) - 1)
    ends = upto + np.arange(len(texts))  # places of the end tokens among the words
    n = sizes[codes]
    after = np.cumsum(n)
    ids = flat[np.arange(after[-1]) + np.repeat(places[codes] - after + n, n)]
    stopped = np.isin(last, STOPS) | turn
    stopped[upto[np.diff(np.concatenate([[0], upto])) > 0] - 1] = False  # the end token follows
    sentence = np.insert(stopped, upto, False)
    return ids, np.diff(np.concatenate([[0], after[ends]])), after[sentence]


def candidate_cuts(ends: np.ndarray, sentences: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions with their penalties; ``ends`` are document ends (the last is the stream's)."""
    pos = np.concatenate([ends, sentences, [0]])
    cost = np.concatenate([np.zeros(len(ends)), np.full(len(sentences), SENTENCE_CUT), [0]]).astype(np.int64)
    order = np.lexsort((cost, pos))
    pos, cost = pos[order], cost[order]
    first = np.concatenate([[True], pos[1:] != pos[:-1]])
    pos, cost = pos[first], cost[first]
    step = min(INNER_STEP, max_len)
    wide = np.nonzero(np.diff(pos) > step)[0]
    inner = [np.arange(pos[k] + step, pos[k + 1], step) for k in wide]
    if inner:
        inner = np.concatenate(inner)
        pos, cost = np.concatenate([pos, inner]), np.concatenate([cost, np.full(len(inner), INNER_CUT, np.int64)])
        order = np.argsort(pos, kind="stable")
        pos, cost = pos[order], cost[order]
    return pos, cost


def best_cuts(pos: np.ndarray, cost: np.ndarray, max_len: int = MAX_LEN) -> list[int]:
    """Indices of the cheapest cuts, from the first candidate to the last.

    ``pos`` rises from 0 in gaps of at most ``max_len``.  The last window costs
    nothing: it is carried into the next block or cut by ``tail_cuts``.
    """
    p, c = pos.tolist(), cost.tolist()
    n = len(p)
    back, value = [0] * n, [0] * n  # value holds the cost of a cut plus its position
    queue = deque([0])
    for j in range(1, n - 1):
        pj = p[j]
        while p[queue[0]] < pj - max_len:
            queue.popleft()
        back[j] = i = queue[0]
        value[j] = here = value[i] + max_len + c[j]
        while queue and value[queue[-1]] >= here:
            queue.pop()
        queue.append(j)
    back[n - 1] = min((i for i in range(n - 1) if p[i] >= p[-1] - max_len), key=lambda i: (value[i] - p[i], -i)) if n > 1 else 0
    cuts, j = [n - 1], n - 1
    while j:
        j = back[j]
        cuts.append(j)
    return cuts[::-1]


def tail_cuts(size: int, ends: set[int], sentences: set[int], max_len: int) -> list[int]:
    """Cheapest cuts of ``size`` tokens (at most ``max_len``), from 0 to ``size``, where powers of two need no padding."""
    powers = [1 << k for k in range(max_len.bit_length()) if 1 << k <= max_len]
    best, back, lead = [0], [0], 0  # ``lead`` is the cut with the least cost plus place so far
    for j in range(1, size + 1):
        cost, i = best[lead] + max_len - (j - lead), lead
        for n in powers:
            if n > j:
                break
            if best[j - n] <= cost:
                cost, i = best[j - n], j - n
        best.append(cost + (0 if j == size or j in ends else SENTENCE_CUT if j in sentences else INNER_CUT))
        back.append(i)
        if best[j] + j < best[lead] + lead:
            lead = j
    cuts = [size]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


class Packer:
    """Packs a stream of encoded documents; ``flush`` returns finished pieces as columns."""

    def __init__(self, first_sequence: int, max_len: int = MAX_LEN, block_tokens: int = BLOCK_TOKENS):
        self.sequence, self.max_len, self.block = first_sequence, max_len, max(block_tokens, 2 * max_len)
        self.ids: list[bytes] = []
        self.docs: list[tuple[int, int, int, int]] = []  # doc_id, tokens before this part, tokens in it, tokens in all
        self.sentences: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_ids: list, sizes: np.ndarray, ids: np.ndarray, sentences: np.ndarray) -> None:
        """Documents in a row: their ids one after another, and offsets just after sentences."""
        self.docs += [(d, 0, n, n) for d, n in zip(doc_ids, sizes.tolist())]
        self.ids.append(ids.astype("<u4", copy=False).tobytes())
        self.sentences.append(sentences + self.size)
        self.size += len(ids)

    @property
    def full(self) -> bool:
        return self.size >= self.block

    def flush(self, final: bool = False) -> list[tuple]:
        """Pieces of all windows but the last (of all windows if ``final``)."""
        if not self.size:
            return []
        ids = b"".join(self.ids)
        ends = np.cumsum([d[2] for d in self.docs])
        sentences = np.concatenate(self.sentences)
        pos, cost = candidate_cuts(ends, sentences[(sentences > 0) & (sentences < self.size)], self.max_len)
        edges = pos[best_cuts(pos, cost, self.max_len)].tolist()
        if final:
            tail = edges[-1] - edges[-2]
            at = edges[-2]
            inside = lambda x: set((x[(x > at) & (x < self.size)] - at).tolist())
            edges = edges[:-2] + [at + k for k in tail_cuts(tail, inside(ends), inside(sentences), self.max_len)]
            keep = self.size
        else:
            edges = edges[:-1]
            keep = edges[-1]
        pieces, k, begins = [], 0, 0
        for a, b in zip(edges, edges[1:]):
            at = a
            while at < b:
                doc_id, before, n, total = self.docs[k]
                stop = min(b, begins + n)
                pieces.append((doc_id, before + at - begins, stop - at, ids[4 * at : 4 * stop], total, self.sequence, at - a))
                at = stop
                if stop == begins + n:
                    k, begins = k + 1, begins + n
            self.sequence += 1
        rest = self.docs[k:]
        if rest and keep > begins:
            doc_id, before, n, total = rest[0]
            rest[0] = (doc_id, before + keep - begins, n - (keep - begins), total)
        self.docs, self.ids, self.size = rest, [ids[4 * keep :]] if keep < self.size else [], self.size - keep
        self.sentences = [sentences[sentences > keep] - keep] if self.size else []
        return pieces


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, *, max_len: int = MAX_LEN, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: its ids (little-endian unsigned 32-bit), place in the document and in the sequence."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_ids(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId() << 40, max_len, block_tokens)
        names = [x.split()[0] for x in PIECES.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

        def columns(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(pieces), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*pieces[k : k + 5000]), kinds)], names)

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), raw_texts(batch.column(1))
            for a, b in slices(texts):
                ids, sizes, sentences = encode(texts[a:b], memo, end_id)
                packer.add(doc_ids[a:b], sizes, ids, sentences)
                if packer.full:
                    yield from columns(packer.flush())
        yield from columns(packer.flush(final=True))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(pack, PIECES)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a CRC of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
