"""Token counts by finite-state transduction (operator 8).

A BPE vocabulary is compiled, on demand, into a deterministic transducer whose
transitions carry the number of tokens by which the encoding of the text read
so far grows (it may shrink: a merge can replace two tokens by one).  The count
of a text is the sum along its path.

*States.*  For the text since the last point where no piece can span, let
``last(i)`` be the last token of the encoding of the first ``i`` characters.
``last(i)`` is the one piece that ends at ``i``, begins at some ``j``, and is
compatible with ``last(j)`` (the two side by side stay unmerged).  Only
positions from which the text read is a prefix of some piece can still be the
beginning of a later token, so the longest such suffix with the tokens and
relative counts at those positions determines every later transition: a finite
state.

*Chunks.*  A character run is cut into chunks.  A chunk maps an incoming state to
an outgoing state and a count.  No piece spans from a non-blank to a blank nor
across a character without a piece, so after the first such point (the
synchronising point) the map no longer depends on the incoming state; a map is
kept as the head before it, the count after it and the state at the end.  Maps
compose associatively; the count of a text is the last element of their prefix
scan, so only the scan's up-sweep is made: neighbours are composed in rounds.

Rows: null text counts as empty; an empty text has no tokens; repeated rows and
ties are counted row by row; an empty table gives an empty result; other
columns are ignored.  A very long text, with or without blanks, takes time and
memory in proportion to its length: a batch of rows, the chunks of one text and
a bounded number of memoised states and words a worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import slices

BLANK = "▁"
#: Characters of text that one chunk map covers.
CHUNK_CHARS = 4096
#: Memoised whole-word transitions and states kept before starting afresh.
MEMO_LIMIT = 800_000
STATE_LIMIT = 300_000
#: The context length above which ``over_limit`` is true.
CONTEXT_TOKENS = 4096


class State:
    __slots__ = ("suffix", "window", "arcs")

    def __init__(self, suffix: str, window: tuple):
        self.suffix, self.window, self.arcs = suffix, window, {}


class CountingTransducer:
    """Transducer of token counts for a score-ranked BPE vocabulary with byte fallback.

    ``ranks`` maps each mergeable piece to its priority (lower merges first).
    """

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks
        order = sorted(ranks, key=lambda p: (len(p) > 1, ranks[p]))
        #: Single characters first, then merged pieces from the first to merge to the last.
        self.order = {p: k for k, p in enumerate(order)}
        self.prefixes = {p[:k] for p in ranks for k in range(1, len(p))}
        self.longest = max(map(len, ranks), default=1)
        self._whole: dict[str, bool] = {}
        self._split: dict[str, tuple[str, str]] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self._state("", (("", 0),))
        self.words: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self.segments: dict[str, int] = {}
        self.heads: dict[str, tuple[State, int]] = {}

    def _forget(self) -> None:
        """Drop all transitions and states but the start; a held state goes on working, and words keep their counts."""
        for state in self.states.values():
            state.arcs = {}
        self.heads.clear()
        self.states = {("", self.start.window): self.start}

    def _state(self, suffix: str, window: tuple) -> State:
        key = (suffix, window)
        found = self.states.get(key)
        if found is None:
            if len(self.states) >= STATE_LIMIT:
                self._forget()
            found = self.states[key] = State(suffix, window)
        return found

    def merge(self, text: str) -> list[str]:
        """The encoding of a short text of known characters, by merging in order of rank."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=None)
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def reachable(self, piece: str) -> bool:
        found = self._whole.get(piece)
        if found is None:
            found = self._whole[piece] = self.merge(piece) == [piece]
        return found

    def halves(self, piece: str) -> tuple[str, str]:
        """The two parts whose merge makes ``piece``; a single character twice."""
        found = self._split.get(piece)
        if found is None:
            parts = list(piece)
            while len(parts) > 2:
                i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            found = self._split[piece] = (parts[0], parts[-1])
        return found

    def compatible(self, a: str, b: str) -> bool:
        """Whether ``a`` and ``b`` side by side stay two tokens.

        The merges of both are undone from the last to the first; were a piece
        across the seam to merge before the next one undone, they would not.
        """
        if not a:
            return True
        order, merged, limit = self.order, self.order.get, 1 << 60
        while True:
            if merged(a + b, 1 << 60) < limit:
                return False
            ra, rb = order[a], order[b]
            if ra > rb and len(a) > 1:
                limit, a = ra, self.halves(a)[1]
            elif len(b) > 1:
                limit, b = rb + 1, self.halves(b)[0]
            elif len(a) > 1:
                limit, a = ra, self.halves(a)[1]
            else:
                return True

    def step(self, state: State, ch: str) -> tuple[State, int]:
        """The transition of ``state`` by ``ch``: next state and change of the count."""
        found = state.arcs.get(ch)
        if found is None:
            found = state.arcs[ch] = self._arc(state, ch)
        return found

    def _arc(self, state: State, ch: str) -> tuple[State, int]:
        if ch not in self.ranks:
            return self.start, len(ch.encode("utf-8", "surrogatepass"))
        seen, window = state.suffix + ch, state.window
        for k in range(len(seen)):
            piece = seen[k:]
            at = window[k]
            if at is not None and piece in self.ranks and self.reachable(piece) and self.compatible(at[0], piece):
                last, delta = piece, at[1] + 1
                break
        else:
            raise AssertionError(f"no encoding ends in {seen!r}")
        keep = next((k for k in range(len(seen)) if seen[k:] in self.prefixes), len(seen))
        after = tuple((at[0], at[1] - delta) if at is not None and seen[keep + k :] in self.prefixes else None for k, at in enumerate(window[keep:])) + ((last, 0),)
        return self._state(seen[keep:], after), delta

    def run(self, state: State, text: str | tuple[str, ...]) -> tuple[State, int]:
        """State after a text, or the strings it consists of, and the change of the count."""
        total = 0
        for part in (text,) if isinstance(text, str) else text:
            for ch in part:
                found = state.arcs.get(ch)
                if found is None:
                    found = self.step(state, ch)
                state, delta = found
                total += delta
        return state, total

    def word(self, word: str, blank: bool) -> int:
        """The count of a whole word from the start state, after a blank or not (memoised)."""
        memo = self.words[blank]
        found = memo.get(word)
        if found is None:
            if len(memo) >= MEMO_LIMIT:
                memo.clear()
            text = BLANK + word if blank else word
            head = self.heads.get(text[:8])
            if head is None:
                if len(self.heads) >= MEMO_LIMIT // 4:
                    self.heads.clear()
                head = self.heads[text[:8]] = self.run(self.start, text[:8])
            found = head[1] + self.run(head[0], text[8:])[1]
            if len(word) <= 40:
                memo[word] = found
        return found

    def segment(self, text: str) -> int:
        """The count, from the start state, of blanks and what follows them (memoised)."""
        found = self.segments.get(text)
        if found is None:
            found = self.run(self.start, text)[1]
            if len(text) <= 40:
                if len(self.segments) >= MEMO_LIMIT:
                    self.segments.clear()
                self.segments[text] = found
        return found


class ChunkMap:
    """State map of a chunk: strings before its synchronising point, the count after it, and the state at the end.

    ``tail is None`` while it has no synchronising point; the strings are parts of
    the text, never joined, so that maps of a text without one stay as small as it.
    """

    __slots__ = ("head", "count", "tail")

    def __init__(self, head: tuple[str, ...], count: int = 0, tail: State | None = None):
        self.head, self.count, self.tail = head, count, tail


#: A word's first blank after a non-blank, where no piece can span; and blanks with what follows them.
SEAM = re.compile(f"[^{BLANK}]{BLANK}")
SEGMENT = re.compile(f"{BLANK}+[^{BLANK}]*")


def chunk_map(t: CountingTransducer, chunk: str) -> ChunkMap:
    """The map of one chunk of text in which blanks stand for spaces."""
    seam = SEAM.search(chunk)
    if seam is None:
        # a character without a piece leads every state to the start
        foreign = min((chunk.find(c) for c in set(chunk) if c not in t.ranks), default=-1)
        if foreign < 0:
            return ChunkMap((chunk,))
        tail, count = t.run(t.start, chunk[foreign + 1 :])
        return ChunkMap((chunk[: foreign + 1],), count, tail)
    at, end = seam.start() + 1, chunk.rfind(BLANK)
    while end > at and chunk[end - 1] == BLANK:
        end -= 1
    end = max(end, at)
    count = count_words(t, chunk[at:end]) if end > at else 0
    tail, more = t.run(t.start, chunk[end:])
    return ChunkMap((chunk[:at],), count + more, tail)


def count_words(t: CountingTransducer, text: str) -> int:
    """Count of a text that begins and ends at seams; a line feed, having no piece, also parts words."""
    if BLANK * 2 in text:
        return sum(t.segment(x) for x in SEGMENT.findall(text))
    newline = "\n" not in t.ranks
    total = 0
    after, plain = t.words[1], t.words[0]
    for k, line in enumerate(text[1:].split("\n") if newline else [text[1:]]):
        words = line.split(BLANK)
        if k:
            total += 1
        first = words[0]
        if k:
            found = plain.get(first)
            total += t.word(first, False) if found is None else found
        else:
            total += t.word(first, True)
        for w in words[1:]:
            found = after.get(w)
            total += t.word(w, True) if found is None else found
    return total


def compose(t: CountingTransducer, a: ChunkMap, b: ChunkMap) -> ChunkMap:
    """The map of ``a`` followed by ``b``; associative."""
    opens = b.head[0][:1] == BLANK
    if a.tail is None:
        if opens and a.head[-1][-1:] != BLANK:
            state, count = t.run(t.start, b.head)
            return ChunkMap(a.head, count + b.count, b.tail or state)
        return ChunkMap(a.head + b.head, b.count, b.tail)
    state = a.tail
    if opens and state.suffix[-1:] != BLANK and (state.window[-1][0][-1:] != BLANK):
        state = t.start
    state, count = t.run(state, b.head)
    return ChunkMap(a.head, a.count + count + b.count, b.tail or state)


def composed(t: CountingTransducer, texts: list[list[ChunkMap]]) -> list[ChunkMap]:
    """The composition of the maps of each text: the up-sweep of a prefix scan, whose last element alone is asked for.

    Every round composes neighbours of all texts that have several maps left, which halves them.
    """
    left = [k for k, maps in enumerate(texts) if len(maps) > 1]
    while left:
        for k in left:
            maps = texts[k]
            texts[k] = [compose(t, a, b) for a, b in zip(maps[::2], maps[1::2])] + (maps[-1:] if len(maps) % 2 else [])
        left = [k for k in left if len(texts[k]) > 1]
    return [maps[0] for maps in texts]


def count_batch(t: CountingTransducer, texts: list[str], chunk_chars: int = CHUNK_CHARS) -> list[int]:
    """Tokens of whole texts that are not empty."""
    chunks = [[chunk_map(t, BLANK * (not i) + text[i : i + chunk_chars].replace(" ", BLANK)) for i in range(0, len(text), chunk_chars)] for text in texts]
    return [t.run(t.start, whole.head)[1] + whole.count for whole in composed(t, chunks)]


def count_tokens(t: CountingTransducer, text: str | None, chunk_chars: int = CHUNK_CHARS) -> int:
    """Tokens of a whole text (null: empty)."""
    return count_batch(t, [text], chunk_chars)[0] if text else 0


_COMPILED: dict[str, CountingTransducer] = {}


def compiled(model_path: str) -> CountingTransducer:
    """The transducer of a sentencepiece BPE model, one a worker process."""
    found = _COMPILED.get(model_path)
    if found is None:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ranks = {p.id_to_piece(i): -p.get_score(i) for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))}
        ordered = sorted(ranks, key=ranks.get)
        found = _COMPILED[model_path] = CountingTransducer({piece: k for k, piece in enumerate(ordered)})
    return found


def count_documents(docs: DataFrame, model_path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", limit: int = CONTEXT_TOKENS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    ``model_path`` is the model's place on the executors (by default the
    installed public vocabulary ``piece_bpe_32k.model``).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path is None:
            import public_tokenizers

            t = compiled(public_tokenizers.path("piece_bpe_32k.model"))
        else:
            t = compiled(model_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [0] * len(texts)
            full = [k for k, x in enumerate(texts) if x]
            for a, b in slices([texts[k] for k in full]):
                for k, found in zip(full[a:b], count_batch(t, [texts[k] for k in full[a:b]])):
                    n[k] = found
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    plain = plain.withColumn("n_bytes", F.octet_length("text").cast("long"))
    return plain.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
