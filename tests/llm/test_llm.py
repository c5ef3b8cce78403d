"""The ten operators against brute force, round trips and held-out accuracy, with the odd rows each must bear."""

import hashlib
import random
import re
import subprocess
import sys
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.llm import chat_format, decontaminate, language_id, license_scan, near_dedup, packing, pii, quality, sharding, token_counts

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n long, score string, spans string"


def docs_of(spark, rows):
    """Documents with columns whose names clash with those of results; ``rows``: (id, text) or (id, text, lang)."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1]), "x", 5, "y", "z") for r in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (5, "Two words"), (6, "é" * 3), (None, "a null id here"), (7, "x " * 30_000), (8, "x " * 30_000)]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(3)
    stems = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    return lambda n, seed: " ".join(random.Random(seed).choices(stems, k=n))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(100, 1, 0), (100, 1, 0), (101, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


# 1 chat formatting


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "a<seg>\\h</turn>\n### x"), (1, 1, "assistant", "\\"), (1, 2, "assistant", "\\\\l#"), (1, 2, "assistant", "\\\\l#"), (1, 3, "user", None),
        (2, None, None, ""), (2, 0, "us\n<#\\er", "é\n"), (3, 5, "assistant", ""), (None, 1, "user", "null id"), (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"),
    ]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    groups = defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((-1 if t is None else t, r or "", x or ""))
    got = {r.conv_id: r for r in chat_format.chat_digests(chat_format.format_chats(turns)).collect()}
    assert set(got) == set(groups)
    for c, v in groups.items():
        v.sort()
        loss = "".join(x for _, r, x in v if r == "assistant")
        want = (len(v), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in v).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want
    merged = chat_format.format_chats(turns).where("conv_id = 1").first().formatted
    assert merged.count("### assistant") == 1 and merged.count("<seg>") == 2
    assert chat_format.chat_digests(chat_format.format_chats(turns.limit(0))).count() == 0


# 2 quality rules


def base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_base_and_verdict(spark, odd, empty, prose, labels):
    rows = ODD + [(100, prose(300, 1)), (101, " ".join(w + "***" for w in prose(300, 2).split())), (102, prose(300, 3)), (103, "\n".join([prose(12, 4)] * 3 + ["<|>"])), (104, prose(8, 5) + " k " + prose(8, 5))]
    got = quality.verdicts(docs_of(spark, rows), labels).collect()
    assert len(got) == len(rows)
    want = Counter((i, *base(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[100].kept and by[101].score < by[102].score < by[100].score and by[7].base_failed and not by[7].kept
    # the score by hand: hashed buckets are the operator's own, so take them from it
    grams = {r.doc_id: r.g for r in docs_of(spark, rows).where("doc_id >= 100").select("doc_id", quality.ngram_buckets(F.col("text")).alias("g")).collect()}
    everything = [b for r in docs_of(spark, rows).select(quality.ngram_buckets(F.col("text")).alias("g")).collect() for b in r.g]
    raw, trusted = Counter(everything), Counter(grams[100])
    share, t_total = {b: n / len(everything) for b, n in raw.items()}, len(grams[100]) + quality.PRIOR
    for i, g in grams.items():
        score = sum(np.log((trusted[b] + quality.PRIOR * share[b]) / t_total / share[b]) for b in g) / len(g)
        assert by[i].score == pytest.approx(score, abs=1e-5)
    assert quality.verdicts(empty, labels).count() == 0
    assert quality.keep_good(docs_of(spark, rows), labels).columns == docs_of(spark, rows).columns
    assert {r.score for r in quality.verdicts(odd, labels.limit(0)).collect()} == {0.0}


# 3 language identification


def test_language_field(spark, odd, empty):
    rng = random.Random(1)
    stems = {"aa": ["ton", "mer", "ing", "the", "of"], "bb": ["eau", "ique", "les", "ent", "oi"], "cc": ["sch", "ung", "der", "ein", "ich"]}
    make = lambda k, n: " ".join("".join(rng.choices(stems[k], k=rng.randint(1, 3))) for _ in range(n))
    rows = [(i, make(k, 90), k) for i in range(300) for k in [sorted(stems)[i % 3]]]
    docs = docs_of(spark, [*rows, *((i, t, None) for i, t in ODD), (900, "123 ... 456", None)])
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows) + len(ODD) + 1
    by = {r.doc_id: r for r in got}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    held = [(by[i].lang_pred, k) for i, _, k in rows if by[i].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3, 900))
    assert all(0 <= r.score <= 1 for r in got)
    assert language_id.identify(empty).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    e, a = rng.random((9, 3)) + 0.1, rng.random((3, 3)) + 0.1
    got = language_id.marginals(e, np.array([4, 0, 5]), a)
    for lo, hi in ((0, 4), (4, 9)):
        want = np.zeros((hi - lo, 3))
        for path in np.ndindex(*[3] * (hi - lo)):
            p = a.sum(axis=0)[path[0]] * e[lo, path[0]]
            for t in range(1, hi - lo):
                p *= a[path[t - 1], path[t]] * e[lo + t, path[t]]
            for t, k in enumerate(path):
                want[t, k] += p
        assert got[lo:hi] == pytest.approx(want / want.sum(axis=1, keepdims=True))
    long = rng.random((1000, 3)) + 0.1
    whole = language_id.marginals(long, np.array([1000]), a)
    v, alpha = np.full(3, 1 / 3), []
    for x in long:
        v = (v @ a) * x
        v /= v.sum()
        alpha.append(v)
    v, out = np.ones(3), np.empty((1000, 3))
    for t in range(999, -1, -1):
        out[t] = alpha[t] * v / (alpha[t] * v).sum()
        v = a @ (long[t] * v)
        v /= v.sum()
    assert whole == pytest.approx(out, abs=1e-9)


def test_language_is_learned_from_short_texts():
    rng = random.Random(5)
    words = {"aa": ["the", "house", "with", "green", "water", "and"], "bb": ["der", "haus", "mit", "blau", "wasser", "und"]}
    field = language_id.train([(" ".join(rng.choices(words[y], k=rng.randint(0, 6))), y) for _ in range(60) for y in words])
    assert np.abs(field.weights).max() > 0
    scores, _ = field.potentials([b"house", b"haus"])
    assert scores.argmax(axis=1).tolist() == [0, 1]


def test_gradient_matches_finite_differences():
    rng = np.random.default_rng(3)
    scores, a = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    rows, gold = rng.integers(0, 7, (5, 6)), rng.integers(0, 3, (5, 6))
    hot = np.eye(3)[gold]
    slope, pairs = language_id.gradient(scores, a, rows, hot, np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:]), block=2)
    by_code = np.stack([np.bincount(rows.ravel(), slope[:, :, k].ravel(), 7) for k in range(3)], axis=1)
    step = 1e-6
    for (i, j), value in np.ndenumerate(by_code):
        moved = scores.copy()
        moved[i, j] += step
        assert (language_id.log_likelihood(moved, a, rows, gold) - language_id.log_likelihood(scores, a, rows, gold)) / step == pytest.approx(value, abs=1e-4)
    # the first word's free predecessor is left out of the transitions' slope
    first = np.zeros((3, 3))
    for codes, marks in zip(rows, gold):
        z = np.exp(a) / np.exp(a)[:, marks[0]].sum()
        first[:, marks[0]] += z[:, marks[0]]
        v = np.ones(3)
        for c in codes[:0:-1]:
            v = np.exp(a) @ (np.exp(scores[c]) * v)
        both = np.exp(a) * (np.exp(scores[codes[0]]) * v)
        first -= both / both.sum()
    for (i, j), value in np.ndenumerate(pairs + first):
        moved = a.copy()
        moved[i, j] += step
        assert (language_id.log_likelihood(scores, moved, rows, gold) - language_id.log_likelihood(scores, a, rows, gold)) / step == pytest.approx(value, abs=1e-4)


def test_whole_texts_are_learned_from():
    texts = [np.arange(k * 1000, k * 1000 + n) for k, n in enumerate((0, 3, 70, 500))]
    rows, gold = language_id.sequences(texts, np.array([0, 0, 1, 2]), np.random.default_rng(0))
    assert set(rows.ravel().tolist()) == set(np.concatenate(texts).tolist()) and rows.shape[1] == language_id.SEQUENCE
    assert all(g == {0: 0, 1: 0, 2: 1, 3: 2}[c // 1000] for c, g in zip(rows.ravel().tolist(), gold.ravel().tolist()))


def test_sample_and_predictions_do_not_depend_on_partitions(spark, prose):
    docs = docs_of(spark, [(i, prose(30, i) + f" {'the' if i % 2 else 'der'}", "en" if i % 2 else "de") for i in range(200)] + [(7, "the same", "en")] * 50)
    one, two = (language_id.training_sample(d, 60) for d in (docs.repartition(2, "text"), docs.repartition(7)))
    assert one == two and len(one) == 60
    a, b = ({(r.doc_id, r.lang_pred, round(r.score, 6)) for r in language_id.identify(d).collect()} for d in (docs.repartition(2, "text"), docs.repartition(7)))
    assert a == b


def test_no_language_is_lost_to_lengths_or_repeats(spark, prose):
    long = "ein sehr langes wort und noch eines " * 4000
    rows = [(i, "the same english row", "en") for i in range(1, 900)] + [(1000 + i, f"une ligne {prose(20, i)}", "fr") for i in range(700)] + [(2001 + i, long + str(i), "de") for i in range(9)]
    docs = docs_of(spark, rows)
    sample = language_id.training_sample(docs, 60)
    counts = Counter(y for _, y in sample)
    assert counts["en"] == 1 and counts["de"] >= 3 and sum(counts.values()) <= 60 and set(counts) == {"en", "fr", "de"}
    assert Counter(y for _, y in language_id.training_sample(docs, 60, budget=1000)) == {"en": 1, "de": 1, "fr": 1}
    only = docs_of(spark, [(i, long + prose(5, i), "de") for i in range(1, 12)])
    assert {r.lang_pred for r in language_id.identify(only).collect()} == {"de"}


def test_a_prediction_follows_from_the_field_word_by_word():
    """Potentials and marginals of whole documents, feature by feature and path by path, against the operator."""
    rng = random.Random(4)
    words = {"aa": ["the", "house", "green", "water"], "bb": ["der", "haus", "blau", "wasser"]}
    field = language_id.train([(" ".join(rng.choices(words[y], k=9)), y) for _ in range(40) for y in words])
    texts = [" ".join(rng.choices(words["aa"] + words["bb"] + ["zz", "12", "Haus!"], k=n)) for n in (1, 4, 7)]
    a = np.exp(field.transitions)
    for text in texts:
        own, codes, _ = language_id.split([text.encode()])
        scores, lettered = field.potentials(own)
        features, owners, whole = language_id.word_features(own)
        inside = field.in_lexicon(whole)
        for k in range(len(own)):
            want = field.weights[features[owners == k]].sum(axis=0) + (field.lexicon_weights[field.lexicon_of[inside[k]]] if inside[k] >= 0 else 0)
            assert scores[k] == pytest.approx(want if lettered[k] else scores[k])
        e = np.exp(scores)[codes]
        mean = np.zeros(2)
        total = 0.0
        for path in np.ndindex(*[2] * len(codes)):
            p = a.sum(axis=0)[path[0]] * e[0, path[0]]
            for t in range(1, len(codes)):
                p *= a[path[t - 1], path[t]] * e[t, path[t]]
            total += p
            for t, k in enumerate(path):
                mean[k] += p * lettered[codes[t]]
        mean /= total
        post = language_id.marginals(e, np.array([len(codes)]), a) * lettered[codes][:, None]
        assert post.sum(axis=0) == pytest.approx(mean)


# 4 license scans


def test_license_scan(spark, odd, empty):
    t = license_scan.TEMPLATES
    rows = [(1, "x\nReleased under the MIT License."), (2, "y " * 9000 + ". " + t["Apache-2.0"] + " And on."), (3, "Released under the terrible license of nobody at all, ever"), (4, t["GPL-2.0"]), (5, t["CC-BY-4.0"]), (6, "no mention"), (7, None), (8, "Released under the MIT Licence.")]
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs_of(spark, rows)).collect()}
    assert {k: v.license for k, v in got.items()} == {1: "MIT", 2: "Apache-2.0", 4: "GPL-2.0", 5: "CC-BY-4.0"}
    assert (got[1].line, got[1].n_different, got[1].differences) == (1, 0, "")
    assert license_scan.scan_licenses(odd).count() == 0 and license_scan.scan_licenses(empty).count() == 0


def test_short_notices_may_differ_in_one_word(spark):
    rows = [
        (1, "All rights reserved."), (2, "Copyright (c) 2024 X. All rights reserved."), (3, "Distributed under the MIT License."), (4, "Licensed under Apache License, Version 2.0."), (5, "All rights are reserved."), (6, "Released under CC BY 4.0."),
        (11, "Some rights reserved; no rights reserved. License"), (12, "Licensed under CC BY SA 4.0."), (13, "Licensed under CC BY 3.0."), (14, "Released under the BSD License."), (15, "This work is not released into the public domain."), (16, "Licensed under the Apache License, Version 1.1."),
    ]
    got = {r.doc_id: (r.license, r.n_different, r.differences) for r in license_scan.scan_licenses(docs_of(spark, rows)).collect()}
    assert got == {
        1: ("Proprietary-notice", 0, ""), 2: ("Proprietary-notice", 0, ""), 3: ("MIT", 1, "-released +distributed"), 4: ("Apache-2.0", 1, "-the"), 5: ("Proprietary-notice", 1, "+are"), 6: ("CC-BY-4.0", 1, "-licensed +released"),
    }


def test_every_license_template_is_compared(spark):
    t = license_scan.TEMPLATES
    half = " ".join(t[k][: len(t[k]) // 2] for k in ("GPL-header", "ISC", "BSD", "CC0-1.0", "MIT-text", "BSD-notice", "MPL-2.0"))
    rows = [(1, f"{half} {t['MIT']}"), (2, f"{half} {t['Proprietary-notice']}"), (3, t["Apache-2.0"].upper())]
    assert {r.doc_id: r.license for r in license_scan.scan_licenses(docs_of(spark, rows)).collect()} == {1: "MIT", 2: "Proprietary-notice", 3: "Apache-2.0"}


def test_license_matches_do_not_depend_on_the_length_of_a_line(spark, prose):
    t = license_scan.TEMPLATES
    notices = [t["Proprietary"], t["Apache-2.0-header"] + ".", t["MIT"] + " " + t["GPL-2.0"]]
    rows = [(10 * k + pad, f"{prose(pad * 300, 1)}. {x} {prose(pad * 300, 2)}") for k, x in enumerate(notices) for pad in (0, 5)]
    assert max(len(text) for _, text in rows) > 12_000
    got = defaultdict(list)
    for r in license_scan.scan_licenses(docs_of(spark, rows)).collect():
        got[r.doc_id].append((r.license, r.saved, r.n_different, r.line))
    for k, names in enumerate([["Proprietary"], ["Apache-2.0-header"], ["MIT", "GPL-2.0"]]):
        assert [x[0] for x in got[10 * k]] == names and got[10 * k] == got[10 * k + 5]


@pytest.mark.parametrize("mark", ["", "# ", "// ", " * ", ";; ", "-- ", "rem ", "dnl ", "C     "])
def test_wrapped_license_notices(mark):
    scanner = license_scan.Scanner()
    for name, text in license_scan.TEMPLATES.items():
        for width in (24, 70):
            wrapped = "\n".join(mark + x for x in textwrap.wrap(text, width, break_on_hyphens=False, break_long_words=False))
            found = scanner.scan(f"/*\n{mark}Some file, by someone\n{mark}\n{wrapped}\n{mark}\n*/\nint main() {{}}\n")
            assert [(x[0], x[1], x[4]) for x in found] == [(3, name, 0)], (name, width)


def test_wrapped_license_notice_in_a_table(spark):
    t = license_scan.TEMPLATES
    rows = [(1, "x = 1\n" + "\n".join("# " + x for x in textwrap.wrap(f"{t['MIT-text']}. {t['Proprietary-notice']}", 72)) + "\nend"), (2, "Permission\nis hereby\ngranted to none")]
    assert [(r.doc_id, r.line, r.license, r.n_different) for r in license_scan.scan_licenses(docs_of(spark, rows)).collect()] == [(1, 1, "MIT-text", 0), (1, 5, "Proprietary-notice", 0)]


def test_license_matches_are_all_found():
    rng = random.Random(4)
    for _ in range(300):
        a, b = [rng.choice("xyz") for _ in range(rng.randint(2, 6))], [rng.choice("xyzw") for _ in range(rng.randint(0, 20))]
        most = rng.randint(0, len(a) // 2)
        spans = {(i, j): decontaminate.edit_distance(a, b[i:j], 99) for i in range(len(b)) for j in range(i + 1, len(b) + 1)}
        found = license_scan.cover(lambda lo, hi: [(*x[:2], x[2] + lo, x[3] + lo) for x in license_scan.matches_of(a, b[lo:hi], most, frozenset())], 0, len(b))
        assert all(spans[i, j] == least <= most for least, _, i, j in found)
        assert all(any(x < j and i < y for _, _, x, y in found) for (i, j), least in spans.items() if least <= most)
        assert all(p[3] <= q[2] for p, q in zip(found, found[1:]))


def test_templates_on_blocks_match_brute_force():
    rng, scanner = random.Random(12), license_scan.Scanner()
    names = sorted(n for n in license_scan.TEMPLATES if len(scanner.words[n]) <= 24)
    filler = "some other words that say little of the work and of its licence to the reader".split()
    for _ in range(40):
        parts = []
        for name in rng.sample(names, 2):
            words = license_scan.TEMPLATES[name].split()
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(filler)
            parts += [*rng.choices(filler, k=rng.randint(0, 6)), *words]
        text = " ".join(parts)
        block = license_scan.words_of(text)
        found = scanner.scan(text)
        near = set()
        for name in names:
            template, (most, protected) = scanner.words[name], scanner.tolerance[name]
            for i in range(len(block)):
                for j in range(i + 1, min(len(block), i + len(template) + most) + 1):
                    if license_scan.Alignment(template, block[i:j], protected).trace(j - i)[0] == 0 and license_scan.Alignment(template, block[i:j], protected).cost[-1][j - i] <= most:
                        near.add((name, i, j))
        assert {x[1] for x in found} <= {n for n, _, _ in near} and bool(found) == bool(near)


def test_whole_licenses_and_tags():
    scanner = license_scan.Scanner()
    for name in ("MIT-full", "ISC-full", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Unlicense"):
        body = license_scan.TEMPLATES[name].replace("THE SOFTWARE", "THE PROGRAM", 1)
        assert [x[1] for x in scanner.scan(f"Copyright (c) 2024 Some Body\n\n{body}\n")] == [name]
    tags = "// SPDX-License-Identifier: MIT\n// SPDX-License-Identifier: GPL-3.0-or-later\n# SPDX-License-Identifier: Unknown-1.0"
    assert [(x[0], x[1]) for x in scanner.scan(tags)] == [(0, "SPDX:MIT"), (1, "SPDX:GPL-3.0-or-later")]
    assert [x[1] for x in scanner.scan("This work is licensed under the GNU Affero General Public License, version 3")] == ["AGPL-3.0"]


def test_headings_and_variants_of_names():
    scanner = license_scan.Scanner()
    wanted = {"MIT License": "MIT-heading", "The MIT License (MIT)": "MIT-heading", "This project is MIT licensed.": "MIT-licensed", "Licensed under CC BY-NC-ND 4.0.": "CC-BY-NC-ND-4.0", "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0", "Released under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0", "Released under the MIT License.": "MIT"}
    assert {t: [x[1] for x in scanner.scan(f"words before\n{t}\nwords after")] for t in wanted} == {t: [k] for t, k in wanted.items()}


def test_wording_is_least():
    rng = random.Random(2)
    for _ in range(200):
        a, b = [rng.choice("xyz") for _ in range(rng.randint(1, 5))], [rng.choice("xyz") for _ in range(rng.randint(0, 7))]
        spans = [b[i:j] for i in range(len(b) + 1) for j in range(i, len(b) + 1)]
        distance = lambda p, q: decontaminate.edit_distance(p, q, 99) if p else len(q)
        assert license_scan.wording(a, b)[0] == min(distance(a, s) for s in spans)


# 5 sharding


@pytest.mark.parametrize("n", [0, 1, 39, 41, 1000])
def test_sharding_rows_law(spark, n):
    rows = [(i, "same") for i in range(n)]
    got = sharding.shard_table(docs_of(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == list(range(n))
    counts = Counter(r.shard for r in got)
    loads = [counts[s] for s in range(40)]
    assert max(loads) - min(loads) <= 1
    for s in range(40):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert all(r.law == "rows" and r.grown_shard is None and r.size == 20 and r.text_crc32 == zlib.crc32(b"same") for r in got)


def test_overflow_walks_the_ring_clockwise():
    rng = random.Random(3)
    for _ in range(60):
        shards = rng.randint(1, 6)
        points = sharding.ring_points(shards, rng.randint(1, 5))
        owners = [s for _, s in points]
        counts = [rng.choice([0, 1, 3, 40]) for _ in owners]
        got = sharding.settle(counts, owners, shards)
        # row by row: keys at their own shard first, then each that found it full goes to the next point clockwise
        low, extra = divmod(sum(counts), shards)
        wish = Counter()
        for n, s in zip(counts, owners):
            wish[s] += n
        room = {s: low for s in range(shards)}
        for s in sorted(range(shards), key=lambda s: (-wish[s], s))[:extra]:
            room[s] += 1
        filled, placed = Counter(), defaultdict(dict)
        waiting = []
        for arc, n in enumerate(counts):
            for rank in range(n):
                s = owners[arc]
                if filled[s] < room[s]:
                    placed[arc][rank] = (s, filled[s])
                    filled[s] += 1
                else:
                    waiting.append((arc, rank))
        for arc, rank in waiting:
            step = 1
            while filled[s := owners[(arc + step) % len(owners)]] >= room[s]:
                step += 1
            placed[arc][rank] = (s, filled[s])
            filled[s] += 1
        for arc, spans in enumerate(got):
            assert {lo + k: (s, slot + k) for lo, hi, s, slot in spans for k in range(hi - lo)} == placed[arc]


def test_rows_belong_to_the_next_point_clockwise(spark):
    from bisect import bisect_left

    shards = 9
    points = sharding.ring_points(shards)
    docs = docs_of(spark, [(i, str(i)) for i in range(2000)])
    places = {r.doc_id: r.p for r in docs.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id"), 2).alias("p")).collect()}
    owner = {i: points[bisect_left([p for p, _ in points], p) % len(points)][1] for i, p in places.items()}
    got = {r.doc_id: r.shard for r in sharding.assign(docs, shards).collect()}
    counts, wish = Counter(got.values()), Counter(owner.values())
    # a shard that is not full beyond its own keys has lost none of them
    assert all(got[i] == owner[i] for i in got if wish[owner[i]] <= counts[owner[i]])
    stayed = Counter(s for i, s in got.items() if s == owner[i])
    assert all(stayed[s] == min(wish[s], counts[s]) for s in range(shards))


def test_sharding_odd_rows_and_movement(spark, odd):
    got = sharding.shard_table(odd).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ODD)
    docs = docs_of(spark, [(i, str(i)) for i in range(3000)])
    a = {r.doc_id: r.shard for r in sharding.assign(docs, 10).collect()}
    b = {r.doc_id: r.shard for r in sharding.assign(docs, 11).collect()}
    assert sum(a[i] != b[i] for i in a) < 0.5 * len(a)
    hot = docs_of(spark, [(7, "same")] * 500)
    assert max(Counter(r.shard for r in sharding.assign(hot, 7).collect()).values()) <= 72


def test_equal_rows_are_dealt_in_blocks(spark):
    docs = docs_of(spark, [(7, "same")] * 501 + [(7, "other")] * 3 + [(i, str(i)) for i in range(100)] + [(None, None)] * 20)
    columns = ["doc_id", "size", "text_crc32", "shard", "slot"]
    whole = Counter(sharding.assign(docs, 5).select(columns).collect())
    assert len(whole) == sum(whole.values()) == 624
    for block in (1, 10, 501):
        assert Counter(sharding.assign(docs, 5, block=block).select(columns).collect()) == whole


# 6 near-duplicates


def shingles(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if 0 < len(words) < width:
        return {tuple(words)}
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute_components(rows, width, percent):
    sets, parent = {i: shingles(t, width) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_match_brute_force(spark, prose):
    rng, rows = random.Random(9), []
    for g in range(12):
        words = prose(120, g).split()
        for k in range(12):
            copy = list(words)
            for _ in range(k // 2):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy).upper() if k == 3 else " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, "Two words"), (1003, "two\nWORDS"), (1004, "É x"), (1005, "é x"), (1006, "q " * 5000), (1007, "q " * 4000)]
    want = brute_components(rows, 4, 80)
    got = near_dedup.dedup_table(docs_of(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = near_dedup.keep_first(docs_of(spark, rows))
    want5 = brute_components(rows, 5, 80)
    assert kept.columns == docs_of(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want5.items() if i == c)


def test_near_duplicates_odd_rows(odd, empty):
    got = near_dedup.dedup_table(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[8].component_id == 7 and by[None].component_id is None and by[1].n_shingles == 0 and by[2].component_id == 2
    assert near_dedup.dedup_table(empty).count() == 0 and near_dedup.keep_first(empty).count() == 0


def test_rows_of_one_id_are_one_document(spark, prose):
    a, b, c, d = (prose(60, 500 + k) for k in range(4))
    rows = [(1, a), (5, a), (5, b), (9, b), (3, c), (3, c), (7, d), (7, None), (8, d), (2, None), (2, "")]
    got = near_dedup.dedup_table(docs_of(spark, rows)).collect()
    want = {1: 1, 5: 1, 9: 1, 3: 3, 7: 7, 8: 7, 2: 2}
    assert len(got) == len(rows) and all(r.component_id == want[r.doc_id] and r.kept == (want[r.doc_id] == r.doc_id) for r in got)
    kept = near_dedup.keep_first(docs_of(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 3, 7] and {r.doc_id: r.text for r in kept}[3] == c


@pytest.mark.parametrize("block", [2, 5, 256])
def test_every_pair_of_a_bucket_meets_once(spark, block):
    members = spark.createDataFrame([(1, i, 11) for i in range(11)] + [(2, i, 3) for i in range(3)] + [(3, 7, 1)], "key long, id long, members long")
    a, b = (x.alias(n) for x, n in zip(near_dedup._block_pairs(members, block), "ab"))
    meet = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("key", "i", "j")]).where("a.own <> b.own or a.id < b.id")
    got = Counter((r[0], *sorted(r[1:])) for r in meet.select("a.key", "a.id", "b.id").collect())
    assert got == Counter((k, i, j) for k, n in ((1, 11), (2, 3)) for j in range(n) for i in range(j))


def test_intermediate_tables_are_released(spark, prose, tmp_path, monkeypatch):
    monkeypatch.setattr("platewise.llm.common.shared_dir", lambda spark: f"file://{tmp_path}")
    near_dedup.dedup_table(docs_of(spark, [(i, prose(60, i // 3) + f" {i}") for i in range(30)])).collect()
    assert [p.name.split("-")[1] for p in tmp_path.iterdir() if p.is_dir()] == ["components"]


def test_components_of_a_long_path(spark):
    rng = random.Random(1)
    order = list(range(200))
    rng.shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:])) + [(500, 501)], "a long, b long").repartition(7)
    got = {r.id: r.root for r in near_dedup.components(links).collect()}
    assert got == {i: 0 for i in range(1, 200)} | {501: 500}


def test_super_min_hash_by_steps():
    rng = np.random.default_rng(5)
    sizes = np.array([1, 3, 0, 40, 500])
    members = rng.integers(0, 2**63, sizes.sum()).astype(np.uint64)
    got, at, slots = near_dedup.super_min_hash(members, sizes, 16), 0, 16
    c = 0x9E3779B97F4A7C15
    for k, n in enumerate(sizes):
        best = [np.iinfo(np.uint64).max] * slots
        for x in members[at : at + n]:
            p = list(range(slots))
            for j in range(slots):
                draw = near_dedup.mix64(np.array([x], np.uint64) + np.uint64((c * (2 * j + 1)) & (2**64 - 1)))
                pick = int(near_dedup.mix64(draw)[0] % np.uint64(slots - j)) + j
                p[j], p[pick] = p[pick], p[j]
                best[p[j]] = min(best[p[j]], int(draw[0] >> np.uint64(8)) | j << 56)
        if n:
            assert got[k].tolist() == best
        at += n
    a, b = rng.integers(0, 2**63, 300).astype(np.uint64), rng.integers(0, 2**63, 100).astype(np.uint64)
    two = near_dedup.super_min_hash(np.concatenate([a, a[:200], b]), np.array([300, 300]), 216)
    assert (two[0] == two[1]).mean() == pytest.approx(0.5, abs=0.12)


# 7 decontamination


def test_leaks_match_brute_force(spark, prose, odd, empty):
    rng = random.Random(4)
    items = [(k, prose(rng.randint(1, 60), 1000 + k)) for k in range(30)] + [(40, None), (41, ""), (42, prose(20, 1))]
    rows = []
    for k, (_, text) in enumerate(items[:30]):
        words = text.split()
        for _ in range(rng.randint(0, len(words) // 4)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["zz"], [words[at], "yy"]])
            words = words or ["zz"]
        rows.append((k, prose(80, 2000 + k) + " " + " ".join(words).capitalize() + ". " + prose(60, 3000 + k)))
    rows += [(50, prose(300, 77)), (51, None), (52, "")]
    norm = lambda t: [w.strip(decontaminate.SIGNS.decode()) or w for w in (t or "").lower().split()]
    want = {}
    for d, t in rows:
        w = norm(t)
        for i, x in items:
            item = norm(x)
            most = len(item) * decontaminate.PERCENT // 100
            near = [decontaminate.edit_distance(item, w[s : s + len(item)], most) for s in range(len(w) - len(item) + 1)] if item else []
            if near and min(near) <= most:
                want[d, i] = min(near)
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    got = decontaminate.find_leaks(docs_of(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id): r.distance for r in got} == want and len(want) > 15
    blocks = decontaminate.find_leaks(docs_of(spark, rows), bench, block_bytes=500).collect()
    assert {(r.doc_id, r.item_id): r.distance for r in blocks} == want
    passes = decontaminate.find_leaks(docs_of(spark, rows), bench, block_bytes=500, pass_blocks=3, buffer_bytes=2000).collect()
    assert {(r.doc_id, r.item_id): r.distance for r in passes} == want
    kept = decontaminate.drop_leaks(docs_of(spark, rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({d for d, _ in rows} - {d for d, _ in want})
    assert decontaminate.find_leaks(empty, bench).count() == 0 and decontaminate.find_leaks(odd, bench.limit(0)).count() == 0
    assert decontaminate.drop_leaks(odd, bench.where("item_id = 42")).count() == len(ODD)
    unnamed = [(None, t) for _, t in rows[25:40]] + [(None, "clean"), (None, None), (None, ""), (60, "clean")]
    left = decontaminate.drop_leaks(docs_of(spark, unnamed), bench).collect()
    bad = {rows[d][1] for d, _ in want if d < 40}
    assert Counter((r.doc_id, r.text) for r in left) == Counter((i, t) for i, t in unnamed if t not in bad) and len(left) < len(unnamed)


@pytest.mark.parametrize("n", [59, 120, 300])
def test_long_items_at_the_threshold_are_candidates(n):
    rng, rows = np.random.default_rng(n), ([], [])
    for _ in range(150):
        item = rng.integers(1, 2**62, n).tolist()
        window, moved = list(item), int(rng.integers(0, n // 10 + 1))
        for k in rng.integers(0, n, n // 5 - 2 * moved).tolist():
            window[k] = int(rng.integers(1, 2**62))
        for _ in range(moved):
            window.pop(int(rng.integers(len(window))))
            window.insert(int(rng.integers(len(window) + 1)), int(rng.integers(1, 2**62)))
        rows[0].append(item)
        rows[1].append(window)
    a, b = (decontaminate.sample_keys(np.array(x, np.uint64)) for x in rows)
    assert (a == b).any(axis=1).all()


# 8 token counts


def test_token_counts_match_library(spark, odd, empty):
    sentencepiece, tokenizers = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    t, rng = token_counts.compiled(tokenizers.path("piece_bpe_32k.model")), random.Random(8)
    bits = ["a", "b", " ", "  ", "the", "ing", "▁", "\n", "<s>", "日", "漢", "\t", "é", "22", "...", "====", "\x00", "er", "tion", "<0x0A>", "ZZ"]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        want = len(lib.encode(text))
        assert [token_counts.count_tokens(t, text, c) for c in (3, 7, 65_536)] == [want] * 3
    got = token_counts.count_documents(odd).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == Counter((i, len((x or "").encode()), n, n > 4096) for i, x in ODD for n in [len(lib.encode(x or ""))])
    assert token_counts.count_documents(empty).count() == 0


def test_every_text_goes_through_chunk_maps(monkeypatch):
    sentencepiece, tokenizers = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    t, rng, seen = token_counts.compiled(tokenizers.path("piece_bpe_32k.model")), random.Random(9), []
    plain = token_counts.chunk_map
    monkeypatch.setattr(token_counts, "chunk_map", lambda t, chunk: seen.append(chunk) or plain(t, chunk))
    for chunk in (1, 2, 5, 17, 64):
        texts = ["".join(rng.choice(["a", " ", "the ", "ing", "▁", "\n", "日", "  ", "é", "1", "ZZ", "."]) for _ in range(rng.randint(1, 60))) for _ in range(120)]
        assert token_counts.count_batch(t, texts, chunk) == [len(lib.encode(x)) for x in texts]
    seen.clear()
    texts = ["one short text", "x", "words " * 5000]
    token_counts.count_batch(t, texts)
    assert len(seen) == 2 + -(-len(texts[2]) // token_counts.CHUNK_CHARS)


def test_chunk_maps_compose_associatively():
    tokenizers = pytest.importorskip("public_tokenizers")
    t, rng = token_counts.compiled(tokenizers.path("piece_bpe_32k.model")), random.Random(5)
    for _ in range(300):
        x, y, z = ("".join(rng.choice("ab▁theing") for _ in range(rng.randint(1, 8))) for _ in range(3))
        a, b, c = (token_counts.chunk_map(t, s) for s in (x, y, z))
        left = token_counts.compose(t, token_counts.compose(t, a, b), c)
        right = token_counts.compose(t, a, token_counts.compose(t, b, c))
        assert t.run(t.start, left.head)[1] + left.count == t.run(t.start, right.head)[1] + right.count
        assert left.tail is right.tail


def test_unbroken_text_takes_bounded_memory():
    tokenizers = pytest.importorskip("public_tokenizers")
    code = (
        "import resource, random, sys; from platewise.llm import token_counts as c; import public_tokenizers as p\n"
        "t = c.compiled(p.path('piece_bpe_32k.model')); random.seed(1)\n"
        "text = ''.join(random.choices('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/', k=20_000)) * int(sys.argv[1])\n"
        "n = c.count_tokens(t, text); print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    )
    found = [list(map(int, subprocess.run([sys.executable, "-c", code, str(k)], capture_output=True, text=True, check=True).stdout.split())) for k in (1, 1000)]
    assert abs(found[1][0] - 1000 * found[0][0]) < 5000 and found[1][1] < 500


# 9 packing


def test_packing_rebuilds_documents(spark, odd, empty, prose):
    tokenizers, library = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    lib = library.Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    rows = [(100 + i, prose(400, i) + ". " + prose(300, i + 50) + "!") for i in range(40)] + [(200, "A<|endoftext|> b"), (201, "İΣ é́ \x1c x"), *ODD]
    docs = docs_of(spark, rows).repartition(3)
    pieces = packing.pack_documents(docs, block_tokens=20_000).collect()
    parts, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        parts[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
        assert len(p.ids) == 4 * p.length > 0
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.MAX_LEN
    once = Counter(i for i, _ in rows)
    for i, text in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids + [2]
        assert {p.doc_tokens for p in parts[i]} == {len(ids)}
        if once[i] == 1:
            assert b"".join(p.ids for p in sorted(parts[i], key=lambda p: p.start)) == np.array(ids, "<u4").tobytes()
    lengths = [sum(p.length for p in s) for s in sequences.values()]
    assert sum(packing.MAX_LEN - n for n in lengths if n & (n - 1)) <= 0.01 * sum(lengths)
    assert packing.pack_documents(empty).count() == 0
    assert packing.piece_digests(packing.pack_documents(odd)).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_cuts_are_optimal():
    rng, most = random.Random(3), 12
    for _ in range(200):
        pos, cost = [0], [0]
        while len(pos) < 12:
            pos.append(pos[-1] + rng.randint(1, 8))
            cost.append(rng.choice([0, 2, 5]))
        n, best = len(pos), {0: 0}
        for j in range(1, n):
            padding = lambda i, j=j: most - (pos[j] - pos[i]) + cost[j] if j < n - 1 else 0
            best[j] = min(best[i] + padding(i) for i in range(j) if pos[j] - pos[i] <= most)
        cuts = packing.best_cuts(np.array(pos), np.array(cost), most)
        assert cuts[0] == 0 and cuts[-1] == n - 1
        assert sum(most - (pos[b] - pos[a]) + cost[b] for a, b in zip(cuts[:-1], cuts[1:-1])) == best[n - 1]


def test_tail_cuts_are_optimal():
    rng, most = random.Random(4), 16
    for _ in range(300):
        size = rng.randint(1, most)
        ends, sentences = (set(rng.sample(range(1, size + 1), rng.randint(0, size // 2))) for _ in range(2))
        price = lambda j: 0 if j == size or j in ends else packing.SENTENCE_CUT if j in sentences else packing.INNER_CUT  # noqa: B023, E731
        pad = lambda n: 0 if n & (n - 1) == 0 else most - n
        best = {0: 0}
        for j in range(1, size + 1):
            best[j] = min(best[i] + pad(j - i) + price(j) for i in range(j))
        cuts = packing.tail_cuts(size, ends, sentences, most)
        assert cuts[0] == 0 and cuts[-1] == size and sum(pad(b - a) + price(b) for a, b in zip(cuts, cuts[1:])) == best[size]


def test_sentences_are_cut_only_to_save_padding(prose):
    tokenizers = pytest.importorskip("public_tokenizers")
    memo = packing.word_ids(tokenizers.path("word_bpe_49k.json"))
    texts = [". ".join(prose(9, 100 * d + k) for k in range(80)).encode() + b".\nA line\n(and an end.) It" for d in range(30)]
    ids, sizes, sentences = packing.encode(texts, memo)
    assert (sizes > 0).all() and len(sentences) == 30 * (80 + 2)
    packer = packing.Packer(0)
    packer.add(list(range(30)), sizes, ids, sentences)
    ends, places = np.cumsum(sizes), set(sentences.tolist())
    cuts, before = [], np.concatenate([[0], ends[:-1]])
    pieces = packer.flush()
    for p, q in zip(pieces, pieces[1:]):
        if p[5] != q[5]:
            cuts.append(int(before[p[0]]) + p[1] + p[2])
    assert len(cuts) > 5 and all(c in places or c in set(ends.tolist()) for c in cuts)


# 10 personal data

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def test_pii_base_matches_python(spark, odd, empty):
    rng = random.Random(6)
    bits = ["a@b.c", "@", ".", "x.y-z@q-r.s.t", "%", "_", " ", "1.2.3.4", "256.1.1.1", "007.0.00000.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+", "(", "9", "12", "é", "\n", "-", "_a@b.c%x@d.e"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for i in range(800)] + [(i + 5000, t) for i, t in enumerate(x for _, x in ODD)] + [(9000, "1 " * 20_000), (9001, "a." * 20_000 + "@" + ".b" * 20_000), (9002, "7" * 50_000)]
    got = {r.doc_id: r for r in pii.span_digests(pii.find_spans(docs_of(spark, rows))).collect()}
    for i, text in rows:
        spans = {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if valid(k, m.group())] for k, p in KINDS.items()} if i < 9000 else None
        if spans is not None:
            joined = ",".join(s for k in KINDS for s in spans[k])
            assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
            assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [len(spans[k]) for k in KINDS]
            assert got[i].spans.startswith(joined)
    assert pii.span_digests(pii.find_spans(empty)).count() == 0


def test_pii_added_kinds_and_redaction(spark, odd):
    text = 'iban: DE89 3704 0044 0532 0130 00 end; bad DE88 3704 0044 0532 0130 00; social security 123-45-6789, plain 123-45-6789 '.ljust(190, ".") + ' token = "24be64439e3e49cf46b2d7c9"; mail a@b.cd'
    rows = [(1, text), (2, "no data"), (3, None), (4, "\U0001f600 a@b.cd \U0001f600")]
    found = {r.doc_id: [s.kind for s in r.spans] for r in pii.find_spans(docs_of(spark, rows)).collect()}
    assert found[1].count("iban") == 1 and "ssn" in found[1] and found[1].count("secret") == 1 and found[2] == found[3] == []
    masked = {r.doc_id: r for r in pii.redact(docs_of(spark, rows)).collect()}
    assert "a@b.cd" not in masked[1].text and "[IBAN]" in masked[1].text and "[SECRET]" in masked[1].text and "DE88" in masked[1].text
    assert masked[2].text == "no data" and masked[3].text is None and masked[4].text == "\U0001f600 [EMAIL] \U0001f600" and masked[4].n_chars == 11
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).count() == len(ODD)


def test_pii_scores_follow_context(spark):
    rows = [(1, "mail me: a@b.cd"), (2, "x a@b.cd"), (3, None)]
    got = {r.doc_id: (r.spans, r.scores) for r in pii.span_digests(pii.find_spans(docs_of(spark, rows))).collect()}
    assert got == {1: ("email:9:15", "0.9"), 2: ("email:2:8", "0.6"), 3: ("", "")}


def test_pii_secrets_after_a_sign_and_of_any_length(spark):
    key, long = "24be6443" * 5, "a1B2" * 300
    rows = [(1, f"api_key={key} end"), (2, f"GET https://example.org/x?token={key}&y=1"), (3, f'token = "{long}" end'), (4, f"password={long}"), (5, f"token={key[:19]} end")]
    got = {r.doc_id: r.text for r in pii.redact(docs_of(spark, rows)).collect()}
    assert got == {1: "api_key=[SECRET] end", 2: "GET https://example.org/x?token=[SECRET]&y=1", 3: 'token = "[SECRET]" end', 4: "password=[SECRET]", 5: rows[4][1]}


def test_pii_many_matches_in_one_text(spark):
    """Work in proportion to the matches; every span and every context by Python."""
    rng = random.Random(12)
    few = ["a@b.cd", "mail c@d.ef", "10.0.0.1", "host 10.0.0.2", "+44 20 7946 0958", "call +1 (743) 555-3824", "4111 1111 1111 1111", "plain words here", "\U0001f600", "é\n"]
    text = "; ".join(rng.choice(few) for _ in range(5000))
    found = pii.find_spans(docs_of(spark, [(1, text)])).first().spans
    for kind, pattern in KINDS.items():
        want = [(m.start(), m.end()) for m in re.finditer(pattern, text) if valid(kind, m.group())]
        assert [(x.start, x.end) for x in found if x.kind == kind] == want and len(want) > 500
    for x in found:
        near = text[max(0, x.start - 40) : x.start] + " " + text[x.end : x.end + 40]
        assert x.score == pytest.approx(0.9 if re.search(f"(?i)(?<![a-z])(?:{pii.CONTEXT[x.kind]})(?![a-z])", near) else 0.6)
    plain, at = [], 0
    for x in sorted(found, key=lambda x: (x.start, x.end, x.kind)):
        if plain and x.start < plain[-1][1]:
            plain[-1][1] = max(plain[-1][1], x.end)
        else:
            plain.append([x.start, x.end, x.kind])
    want = ""
    for a, b, kind in plain:
        want, at = want + text[at:a] + f"[{kind.upper()}]", b
    assert pii.redact(docs_of(spark, [(1, text)])).first().text == want + text[at:]


def test_pii_time_follows_the_matches(spark):
    import time

    def seconds(n):
        began = time.time()
        assert pii.redact(docs_of(spark, [(1, "; ".join(f"user{k}@mail{k}.org" for k in range(n)))])).first().text.count("[EMAIL]") == n
        return time.time() - began

    seconds(100)
    assert seconds(40_000) < 60
