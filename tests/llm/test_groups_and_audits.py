"""Operators 11 to 13 against brute force, with the odd rows each must bear."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from platewise.llm import filter_audit, simhash, whitening

SCHEMA = "doc_id long, text string, lang string, fp string, digest string, n long, component_id string"


def docs_of(spark, rows):
    """Documents with columns whose names clash with those of results; ``rows``: (id, text) or (id, text, lang)."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "f", "d", 3, "c") for r in rows], SCHEMA)


def words_of(text):
    return "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in text or "").split(" ")


def tokens(text, lower=True):
    lowered = "".join(chr(ord(c) + 32) if lower and "A" <= c <= "Z" else c for c in text or "")
    return [w for w in words_of(lowered) if w]


# 11 SimHash


def slow_fingerprint(text, width=4):
    w = tokens(text)
    grams = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def slow_groups(values, radius):
    """Least index reachable by links within ``radius``."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= radius:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    stems = ["".join(rng.choice("bcdfglmnprstBCÉß") + rng.choice("aeiouA") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    texts = [" ".join(rng.choices(stems, k=rng.choice([1, 3, 4, 5, 40, 400]))) for _ in range(120)]
    for k in range(60):
        w = texts[k].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(stems)
        texts.append(rng.choice(["  ", "\n", "\x0b\t"]).join(w))
    texts += ["", None, "  \n", "A", "a", "x " * 30_000, "X " * 29_999, "nul\x00l", "w" * 70_000, "  a b \x1c c"]
    return [(i * 3 + 2, t) for i, t in enumerate(texts)] + [(5, texts[1]), (5, texts[0]), (5, "something else")]


def test_fingerprints_and_groups_match_brute_force(spark, corpus):
    rng = random.Random(1)
    shuffled = rng.sample(corpus, len(corpus))
    got = simhash.group_table(docs_of(spark, shuffled).repartition(7)).collect()
    values = [slow_fingerprint(t) for _, t in corpus]
    least = defaultdict(list)
    for (i, _), r in zip(corpus, slow_groups(values, 4)):
        least[r].append(i)
    want = Counter((i, f"{v:016x}", min(least[r])) for (i, _), v, r in zip(corpus, values, slow_groups(values, 4)))
    assert Counter(tuple(r) for r in got) == want
    assert len(least) < len(set(values))  # some links join different fingerprints


@pytest.mark.parametrize("radius", [1, 2, 3, 4, 5])
def test_every_pair_within_the_radius_shares_a_table(radius):
    rng = random.Random(radius)
    for level in range(3):
        masks = simhash.covering_masks(radius, level)
        assert len(masks) == 2 ** (radius + 1) - 1
        assert all(27 <= m.bit_count() <= 44 for m in masks)
        for _ in range(3000):
            apart = sum(1 << k for k in rng.sample(range(64), radius))
            assert any(not m & apart for m in masks)


@pytest.mark.parametrize("block", [2, 5, 256])
def test_links_of_fingerprints_match_brute_force(spark, block):
    """Dense clusters, chains and lone values; small blocks send buckets through several families."""
    rng = random.Random(block)
    values = {0, (1 << 64) - 1}
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(40):
            values.add(centre ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 6))))
    chain = rng.getrandbits(64)
    for k in range(0, 60, 4):  # each four from the next
        values.add(chain := chain ^ sum(1 << j for j in range(k, k + 4)))
    values |= {rng.getrandbits(64) for _ in range(40)}
    order = sorted(values, key=lambda v: v - (1 << 64) if v >> 63 else v)
    signed = [v - (1 << 64) if v >> 63 else v for v in order]
    got = simhash.link_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp long"), 4, block).collect()
    assert sorted((r.fp, r.root) for r in got) == sorted((signed[i], signed[r]) for i, r in enumerate(slow_groups(order, 4)))


def test_simhash_buckets_are_not_broadcast(spark, monkeypatch):
    plans, write = {}, simhash.materialize

    def noted(df, label):
        plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(simhash, "materialize", noted)
    near = spark.range(72).select(F.expr("xxhash64(id div 12) ^ shiftleft(1L, int(id % 12))").alias("fp"))  # of known, small size
    found = simhash.link_fingerprints(near, 4).agg(F.count("*"), F.count_distinct("root")).first()
    assert tuple(found) == (72, 6)
    # a member is in 31 buckets, which a plan counts as one row
    assert not [p for label in ("shared", "groups") for p in plans[label] if "BroadcastHashJoin" in p]


def test_null_ids_link_but_name_no_group(spark):
    rows = [(None, "one two three four five"), (9, "one two three four five"), (None, "lone text of its own here"), (4, None), (7, " ")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.group_table(docs_of(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 9), (9, 9), (None, None), (4, 4), (7, 4)], key=str)
    kept = simhash.keep_first(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [4, 9, None, None]


def test_no_documents_no_groups(spark):
    assert simhash.group_table(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_texts_are_dealt_out(spark):
    found = simhash.near_duplicates(docs_of(spark, [(i, "the same words in every row") for i in range(500)] + [(600, "other words than those above")]))
    assert found.groupBy("component_id").count().sort("component_id").collect() == [(0, 500), (600, 1)]


# 12 whitening

VECTORS = "vec_id long, embedding array<float>, x string, n string, component string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "x", "n", "c") for i, v in rows], VECTORS)


def test_whitening_matches_a_dense_decomposition(spark):
    rng = np.random.default_rng(3)
    basis = rng.normal(size=(40, 40)) * np.linspace(0.02, 1, 40)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(200, 40)) @ basis)]
    rows += [rows[3], (None, rows[4][1])]
    odd = [(900, None), (901, [None] * 40), (902, [float("nan")] * 40), (903, [1.0] * 39 + [float("-inf")]), (904, []), (905, [1.0, 2.0])]
    got = whitening.whiten(vectors_of(spark, rows + odd).repartition(5)).collect()
    x = np.floor(np.array([v for _, v in rows], np.float32).astype(float) * 64).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = (x * n - s) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    assert {r.n for r in got} == {n} and len(got) == n * 32 and {r.component for r in got} == set(range(1, 33))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    deviation = defaultdict(set)
    for i, d in zip((i for i, _ in rows), ((x * n - s) ** 2).sum(axis=1).tolist()):
        deviation[i].add(d)
    assert all(r.deviation in deviation[r.vec_id] for r in got)
    share = {r.component: r.explained for r in got}
    assert all(abs(share[k + 1] / (values[k] / values.sum()) - 1) < 1e-9 for k in range(32))
    by = defaultdict(dict)
    for r in got:
        if r.vec_id not in (None, 3):
            by[r.component][r.vec_id] = r.whitened
    for k in range(32):
        want = centred @ axes[:, k] / values[k] ** 0.5
        seen = np.array([by[k + 1][i] for i in sorted(by[k + 1])])
        want = np.array([want[i] for i in sorted(by[k + 1])])
        assert min(np.abs(seen - want).max(), np.abs(seen + want).max()) < 1e-6


def test_few_dimensions_and_missing_variance(spark):
    got = whitening.whiten(vectors_of(spark, [(1, [0.0, 5.0]), (2, [1.0, 5.0]), (3, [2.0, 5.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, round(r.explained, 9)) for r in got) == [(1, 1, 3, 192**2, 1.0), (2, 1, 3, 0, 1.0), (3, 1, 3, 192**2, 1.0)]
    assert sorted(round(abs(r.whitened), 9) for r in got) == [0.0, round(1.5**0.5, 9), round(1.5**0.5, 9)]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_tables_without_variance_give_no_components(spark, rows):
    found = whitening.whiten(vectors_of(spark, rows))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and found.count() == 0


def test_ties_between_lengths_go_to_the_longer(spark):
    got = whitening.whiten(vectors_of(spark, [(1, [0.0]), (2, [1.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0])])).collect()
    assert {r.vec_id for r in got} == {3, 4}


# 13 filter interactions


def slow_audit(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    parts = defaultdict(list)
    for i, t, lang in docs:
        t = t or ""
        w = tokens(t, lower=False)
        fails = {k for k, f in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > first[t])) if f}
        parts[lang or ""].append((fails, i is not None and i in good, i is not None and i in toxic))
    rows, shares = [], Counter()
    for part, held in parts.items():
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                reach = [(fails, g, x) for fails, g, x in held if not fails & set(order[: step - 1])]
                gone = [r for r in reach if f in r[0]]
                alone, failing = sum(r[0] == {f} for r in held), sum(f in r[0] for r in held)
                shares[part, f] += len(gone)
                rows.append((part, "".join(order), step, len(reach) - len(gone), len(gone), failing - len(gone), alone, sum(r[1] for r in gone), sum(r[2] for r in gone)))
    return sorted((*r, shares[r[0], r[1][r[2] - 1]]) for r in rows)


def test_audit_matches_enumeration(spark):
    rng = random.Random(2)
    stems = ["alpha", "Beta", "GAMMA", "d#", "e$", "f", "g", "é", "hh|", "ii"] + [f"w{k}" for k in range(300)]
    docs = []
    for i in range(150):
        words = rng.choices(stems[: rng.choice([8, 30, 310])], k=rng.choice([0, 5, 199, 200, 201, 400]))
        if rng.random() < 0.5:
            words = [w for w in words if not set(w) & set("#$%&*|")]
        docs.append((i, rng.choice([" ", "\n", " \x0b"]).join(words), rng.choice(["en", "fr", "", None])))
    docs += [(200 + k, *docs[rng.randrange(100)][1:]) for k in range(60)]
    docs += [(7, docs[7][1], "fr"), docs[8], (300, None, "de"), (301, "", "de"), (None, docs[0][1], "en"), (None, "lone", None), (2, "x " * 30_000, "en"), (2, "A" * 4 + "é" * 96, "en"), (2, "A" * 3 + "é" * 97, "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 210, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (5000, 1, 1)]
    got = filter_audit.audit(docs_of(spark, docs).repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == slow_audit(docs, labels)


def test_audit_of_no_documents_or_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark.createDataFrame([], SCHEMA), none).count() == 0
    got = filter_audit.audit(docs_of(spark, [(1, "a b"), (2, "a b")]), none)
    assert got.count() == 600 and got.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_audit_uses_expressions_only(spark):
    docs = docs_of(spark, [(1, "a b"), (2, "a b")])
    plan = filter_audit.masked(docs.select("doc_id", "text", "lang"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
