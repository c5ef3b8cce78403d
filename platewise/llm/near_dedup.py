"""Near-duplicate grouping by SuperMinHash, banding, verification and union-find (operator 6).

*Sets.*  A document's set holds the hashes of its distinct word shingles; with
fewer words than a shingle, the whole sequence is the one member; without words
it is empty.  Documents with one and the same set form a class (two 64-bit sums
over the set and its size tell classes apart) and only the least id of a class
goes on, so groups of copies are aggregated before any shuffle of rows.

*Signatures.*  SuperMinHash ranks each member by a permutation that is drawn step
by step: step ``j`` of member ``x`` offers the value ``j + u`` to one slot, and
no slot twice.  The least value offered is kept.  All members take step ``j``
before any takes ``j + 1``; once every slot holds a value under ``j + 1`` later
steps cannot change it, so large sets stop after a step or two.

*Candidates.*  ``BANDS`` bands of ``ROWS`` slots; two sets of similarity ``s``
share a band with probability ``1 - (1 - s**ROWS)**BANDS`` (at 0.8: all but about
2 in 100,000; at 0.5: under half; at 0.3: 3 %).  In a band bucket each member is
first paired with the bucket's least id only (a star, never all pairs); verified
links are grouped.  A later round does so again with other hubs.  Only where a
bucket then still holds members of different groups are members of different
groups paired, if their sizes and bitmaps, which lose nothing, leave the
threshold possible (``sketch=True`` also asks a 4-bit sketch of the signature, which
errs on a pair at the threshold with probability below 1e-6).  A large
bucket is dealt to blocks of ``BLOCK_MEMBERS``, and each pair of blocks is a key of
its own, so that no task gets a whole hot bucket.

*Verification* compares full sets: a link needs ``100 * common >= percent * union``.

*Grouping* is union-find: within tasks first, then by alternating large-star and
small-star steps over the tables, to the least reachable id.

Rows: null text counts as having no words; a document without words is linked
with nothing; very long texts are taken in whole; rows of one id are one document
with links through any of its texts, so they have one component (``keep_first``
keeps one row of an id: that of the text with the least hash, then of the least
text and other columns); of a group the least id stands for it, so ties cannot
arise; a null id is kept as its own, unlinked row; an empty table gives an empty
result; other columns are ignored by ``near_duplicates`` and kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import U64, Words, materialize, mix64, raw_texts, release, slices

#: Bands and slots a band; the signature has their product of slots (at most 256).
BANDS, ROWS = 36, 6
#: Candidate ids are broadcast up to this many, joined by shuffling beyond.
BROADCAST_IDS = 500_000
#: Rounds of stars before members of different groups are paired.
STAR_ROUNDS = 2
#: Members of a bucket that are paired within one key.
BLOCK_MEMBERS = 256
SKETCH_BITS = 4
#: Bits of the bitmap of a set's members.
BITMAP = 2048
SKETCH_LONGS = (BANDS * ROWS * SKETCH_BITS + 63) // 64


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one after another and sorted within each, and their numbers."""
    raw = (b"\n".join(texts) + b"\n").lower()  # bytes: A-Z only
    words = Words(raw)
    stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    upto = np.searchsorted(words.starts, stops)
    n = np.diff(np.concatenate([[0], upto]))
    doc = np.repeat(np.arange(len(texts)), n)
    keys = words.keys
    h = np.zeros(max(0, len(keys) - width + 1), U64)
    for k in range(width):
        h = mix64(h * U64(0x9E3779B97F4A7C15) + keys[k : k + len(h)])
    whole = doc[: len(h)] == doc[width - 1 :] if len(h) else np.zeros(0, bool)
    h, owner = h[whole], doc[: len(h)][whole]
    short = np.nonzero((n > 0) & (n < width))[0]
    if len(short):
        extra = []
        for d in short:
            x = np.array([n[d]], U64)
            for k in range(upto[d] - n[d], upto[d]):
                x = mix64(x * U64(0xD1B54A32D192ED03) + keys[k])
            extra.append(x[0])
        h, owner = np.concatenate([h, np.array(extra, U64)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    sizes = np.bincount(owner, minlength=len(texts))
    ends = np.cumsum(sizes)
    parts = []
    for a, b in zip((ends - sizes).tolist(), ends.tolist()):
        part = np.sort(h[a:b])
        parts.append(part[np.concatenate([[True], part[1:] != part[:-1]])] if b > a else part)
    return np.concatenate(parts) if parts else h, np.fromiter(map(len, parts), np.int64, len(parts))


def super_min_hash(members: np.ndarray, sizes: np.ndarray, slots: int) -> np.ndarray:
    """Signatures (sets x slots) of sets that lie one after another; values are step << 56 plus a 56-bit fraction."""
    sets = len(sizes)
    best = np.full(sets * slots, np.iinfo(np.uint64).max, U64)
    if not sets or not len(members):
        return best.reshape(sets, slots)
    owner = np.repeat(np.arange(sets), sizes)
    live, perm = members, None
    for step in range(slots):
        draw = mix64(live + U64((0x9E3779B97F4A7C15 * (2 * step + 1)) & (2**64 - 1)))
        pick = (mix64(draw) % U64(slots - step)).astype(np.int64) + step
        rows = np.arange(len(live))
        if step == 0:
            slot = pick
        else:
            if perm is None:
                perm = np.tile(np.arange(slots, dtype=np.uint8), (len(live), 1))
                perm[rows, first] = 0  # the swap of step 0
                perm[rows, 0] = first
            slot = perm[rows, pick].astype(np.int64)
            perm[rows, pick] = perm[rows, step]
            perm[rows, step] = slot
        np.minimum.at(best, owner * slots + slot, (draw >> U64(8)) | U64(step << 56))
        open_sets = best.reshape(sets, slots).max(axis=1) >= U64((step + 1) << 56)
        keep = open_sets[owner]
        if step == 0:
            first = pick[keep]
        if not keep.any():
            break
        if not keep.all():
            live, owner = live[keep], owner[keep]
            perm = None if perm is None else perm[keep]
    return best.reshape(sets, slots)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each set and band."""
    h = np.tile(mix64(np.arange(1, bands + 1, dtype=U64)), (len(signatures), 1))
    by = signatures[:, : bands * rows].reshape(len(signatures), bands, rows)
    for k in range(rows):
        h = mix64(h * U64(0x9E3779B97F4A7C15) + by[:, :, k])
    return h.view(np.int64)


def sketches(signatures: np.ndarray) -> np.ndarray:
    """``SKETCH_BITS`` hashed bits of each slot, packed into 64-bit numbers."""
    bits = (mix64(signatures)[:, :, None] >> np.arange(SKETCH_BITS, dtype=U64)) & U64(1)
    flat = bits.reshape(len(signatures), -1).astype(np.uint8)
    padded = np.zeros((len(signatures), SKETCH_LONGS * 64), np.uint8)
    padded[:, : flat.shape[1]] = flat
    return np.packbits(padded, axis=1).view(np.int64)


def bitmaps(members: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashed bitmaps of sets that lie one after another, as 64-bit numbers."""
    bits = np.zeros(len(sizes) * BITMAP, np.uint8)
    bits[np.repeat(np.arange(len(sizes)), sizes) * BITMAP + (mix64(members) & U64(BITMAP - 1)).astype(np.int64)] = 1
    return np.packbits(bits.reshape(len(sizes), BITMAP), axis=1).view(np.int64)


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel()))


def _signed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, n, f1, f2, bands, sketch, bits`` of every row."""
    slots = bands * rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch.column(1))
            for a, b in slices(texts, 3_000_000):
                members, sizes = shingle_sets(texts[a:b], width)
                signatures = super_min_hash(members, sizes, slots)
                ends = np.cumsum(sizes)
                sums = []
                for salt in (0x165667B19E3779F9, 0x27D4EB2F165667C5):
                    total = np.concatenate([[U64(0)], np.cumsum(mix64(members ^ U64(salt)))])
                    sums.append((total[ends] - total[ends - sizes]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes), *map(pa.array, sums), _lists(band_keys(signatures, bands, rows)), _lists(sketches(signatures)), _lists(bitmaps(members, sizes))],
                    ["doc_id", "n", "f1", "f2", "bands", "sketch", "bits"],
                )

    return docs.mapInArrow(sign, "doc_id long, n long, f1 long, f2 long, bands array<long>, sketch array<long>, bits array<long>")


def _possible(a: str, b: str, percent: int, sketch: bool = True) -> Column:
    """Whether sizes, bitmaps and (if wished) sketches of two members leave a similarity of ``percent`` possible."""
    slots = BANDS * ROWS
    expected = 1 - (1 - percent / 100) / 2
    spread = (percent / 100 * (1 - percent / 100) / 4 / slots + 0.25 * (1 - percent / 100) / (slots * SKETCH_BITS)) ** 0.5
    most = int((1 - expected + 5 * spread) * slots * SKETCH_BITS)
    differing = "+".join(f"bit_count({a}.sketch[{k}] ^ {b}.sketch[{k}])" for k in range(SKETCH_LONGS))
    held = f"aggregate(zip_with({a}.bits, {b}.bits, (x, y) -> bit_count(x & y)), 0, (s, x) -> s + x)"
    count = lambda side: f"aggregate({side}.bits, 0, (s, x) -> s + bit_count(x))"
    common = f"least({a}.n - {count(a)} + {held}, {b}.n - {count(b)} + {held})"
    bounded = f"{100 + percent} * ({common}) >= {percent} * ({a}.n + {b}.n)"
    alike = f"{differing} <= {most}" if sketch else "true"
    return F.expr(f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and {alike} and {bounded}")


def verify(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` (ids) whose full sets are similar enough."""
    ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    n = ids.count()
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    texts = texts.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "id", "left_semi")
    texts = materialize(texts, "texts")
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys, keep = raw_texts(batch.column(2)), raw_texts(batch.column(3)), []
            for a, b in slices([x + y for x, y in zip(xs, ys)], 2_000_000):
                left, ln = shingle_sets(xs[a:b], width)
                right, rn = shingle_sets(ys[a:b], width)
                le, re = np.cumsum(ln), np.cumsum(rn)
                for p, q, i, j in zip((le - ln).tolist(), le.tolist(), (re - rn).tolist(), re.tolist()):
                    common = len(np.intersect1d(left[p:q], right[i:j], assume_unique=True))
                    keep.append(100 * common >= percent * (q - p + j - i - common) and common > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = materialize(both.mapInArrow(compare, "a long, b long"), "links")
    release(texts)
    release(ids)
    return links


def _local_forest(links: DataFrame) -> DataFrame:
    """Union-find within each task: links to the least id of each local tree."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        rows = [(x, root(x)) for x in list(parent) if root(x) != x]
        for k in range(0, len(rows), 10_000):
            part = rows[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64())], ["u", "v"])

    return links.mapInArrow(unite, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """``id, root`` of every linked id; ``links`` has two id columns."""
    edges = materialize(_local_forest(links).where("u <> v").distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    while True:
        # large-star: neighbours above an id move to its least neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: an id and its neighbours below move to the least of them
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), F.col("m")))).alias("e"))
        after = materialize(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), "edges")
        # done when each id has one edge, to an id that has none below it
        counts = after.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
        open_ids = counts.where("n > 1").select("u").union(after.join(after.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").select("u"))
        settled = open_ids.isEmpty()
        release(edges)
        edges = after
        if settled:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _repeated(signed: DataFrame) -> DataFrame:
    """``doc_id, many`` of ids with several rows; ``many`` tells that their sets differ."""
    counted = signed.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), (F.min("f1") < F.max("f1")).alias("many"))
    return counted.where("rows > 1").select("doc_id", "many")


def _block_pairs(members: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join that pairs members of a bucket: each side is dealt to the pairs of blocks it takes part in.

    ``members`` has ``key, id, members``; the keys of the join are ``key, i, j``.
    """
    blocks = F.ceil(F.col("members") / block).cast("int")
    placed = members.withColumn("last", blocks - 1).withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    left = placed.withColumn("j", F.explode(F.sequence("own", "last"))).withColumn("i", F.col("own"))
    right = placed.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("own")))).withColumn("j", F.col("own"))
    return left, right


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, star_rounds: int = STAR_ROUNDS, sketch: bool = False, block: int = BLOCK_MEMBERS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; sets are of ``shingle``-word shingles."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    signed = materialize(_signed(plain, shingle, bands, rows), "signed")
    used = [signed]

    def keep(df: DataFrame, label: str) -> DataFrame:
        used.append(materialize(df, label))
        return used[-1]

    # one class for each set: its least id stands for it
    classes = keep(signed.where("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = signed.join(classes.select(F.col("rep").alias("doc_id"), "f1", "f2", "n"), ["doc_id", "f1", "f2", "n"], "left_semi")
    banded = reps.select(F.explode("bands").alias("key"), F.struct(F.col("doc_id").alias("id"), "n").alias("m"))
    hubs = banded.groupBy("key").agg(F.min("m").alias("hub"), F.count("*").alias("members")).where("members > 1")
    shared = keep(banded.join(hubs.select("key", "hub"), "key").select("key", F.col("m.id").alias("id"), F.col("m.n").alias("n"), F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n")), "shared")
    fits = f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)"
    pairs = shared.where(f"id <> hub and {fits}").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = verify(keep(pairs, "pairs"), plain, shingle, percent)
    used.append(links)
    # an id with several sets ties their classes together
    repeated = keep(_repeated(signed), "repeated")
    split = repeated.where("many").select("doc_id")
    if not split.isEmpty():
        tied = signed.where("n > 0").join(split, "doc_id", "left_semi").join(classes, ["f1", "f2", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        links = links.union(keep(tied.where("a <> b").distinct(), "tied"))
    found = components(links)
    used.append(found)
    for k in range(star_rounds):
        named = keep(shared.select("key", "id", "n").join(found, "id", "left").withColumn("root", F.coalesce("root", "id")), "named")
        groups = keep(named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members")).where("lo < hi"), "groups")
        if groups.isEmpty():
            break
        left = named.join(groups.select("key", "members"), "key")
        if k < star_rounds - 1:
            order = F.struct(F.xxhash64("id", F.lit(k)).alias("h"), F.col("id"), F.col("n"), F.col("root"))
            hub = keep(left.groupBy("key").agg(F.min(order).alias("hub")), "hubs")
            tried = left.join(hub, "key").where("root <> hub.root").withColumns({"hub_n": F.col("hub.n"), "hub": F.col("hub.id")}).where(fits)
            pairs = tried.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        else:
            full = left.join(reps.select(F.col("doc_id").alias("id"), "sketch", "bits"), "id")
            a, b = (side.alias(name) for side, name in zip(_block_pairs(full, block), "ab"))
            once = (F.col("a.own") != F.col("b.own")) | (F.col("a.id") < F.col("b.id"))
            meet = (F.col("a.key") == F.col("b.key")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
            pairs = a.join(b, meet & once & (F.col("a.root") != F.col("b.root")) & _possible("a", "b", percent, sketch))
            pairs = pairs.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()
        more = verify(keep(pairs, "pairs"), plain, shingle, percent)
        used.append(more)
        links = links.union(more)
        found = components(links)
        used.append(found)
    named = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("f1", "f2", "n", F.coalesce("root", "rep").alias("component_id"))
    result = signed.select("doc_id", "n", "f1", "f2").join(named, ["f1", "f2", "n"], "left")
    result = result.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    if not split.isEmpty():  # rows without words of such an id, too
        one = result.join(split, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("one"))
        result = result.join(one, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("one", "component_id").alias("component_id"))
    result = materialize(result, "components")
    for table in used:
        release(table)
    return result


def dedup_table(docs: DataFrame, *, shingle: int = 4, percent: int = 80) -> DataFrame:
    return near_duplicates(docs, shingle=shingle, percent=percent).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those in the group of a lesser id; one row of each id."""
    found = near_duplicates(docs, shingle=shingle, percent=percent)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    clashing = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"))
    kept = clashing.join(gone, "doc_id", "left_anti")
    several = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not several.isEmpty():
        again = kept.join(several, "doc_id", "left_semi")
        order = F.struct(F.xxhash64("_row.text").alias("h"), F.coalesce(F.col("_row.text"), F.lit("")).alias("text"), F.to_json("_row").alias("row"))
        first = again.groupBy("doc_id").agg(F.min_by("_row", order).alias("_row"))
        kept = kept.join(several, "doc_id", "left_anti").select("_row").union(first.select("_row"))
    return kept.select("_row.*")
