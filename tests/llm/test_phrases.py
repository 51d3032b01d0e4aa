"""Collocations against a brute-force count, with dictionaries and groups of any size."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from kinelake.llm import phrases


def brute(rows, least, longest=5, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang, text = lang or "und", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least}
        found = []
        for p, a in often.items():
            if len(p) == 1 or any(c >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, c in often.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, x, y) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, x, y, n[lang], -score))
    return sorted(out)


def made_rows():
    rng = random.Random(4)
    words = ["the", "of", "The", "é", "漢字", "a b", "x\x1cy", "'s", "|", " ", "\t", "aa", "b-c", "zebra", "Ümlaut", "w\x00", ""]
    rows = []
    for _ in range(300):
        parts = [rng.choice(words[: rng.choice([3, 8, len(words)])]) + rng.choice([" ", "  ", "\t", ", ", ".", "\n", " \r\n", "! "][: rng.choice([3, 8])]) for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice(["en", "en", "de", None]), "".join(parts)))
    rows += [("en", "one very common line of seven words")] * 150 + [("en", None), ("und", "the of the of"), ("fr", "a b c"), ("de", ""), ("de", "zebra " * 500)]
    return rows


@pytest.mark.parametrize("settings", [{}, {"dictionary": 3}, {"dictionary": 0}, {"bucket": 40}, {"dictionary": 4, "bucket": 40}])
def test_collocations_equal_brute_force(spark, settings):
    rows = made_rows()
    docs = spark.createDataFrame([(i, x, t, "s") for i, (x, t) in enumerate(rows)], "item long, lang string, text string, phrase string").repartition(5)
    found = sorted(tuple(r) for r in phrases.collocations(docs, least=10, **settings).collect())
    want = brute(rows, 10)
    assert len(want) > 30 and found == want


def test_top_is_cut_by_score_count_and_phrase(spark):
    rows = made_rows()
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in phrases.collocations(docs, top=5, least=10).collect()) == brute(rows, 10, top=5)


def test_nothing_frequent_and_an_empty_table(spark):
    docs = spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")
    assert phrases.collocations(docs).count() == 0 and phrases.collocations(docs.limit(0)).count() == 0


def test_equal_parts_are_counts_of_beginnings():
    rng = np.random.default_rng(0)
    for least in (1, 7, 60):
        matrix, weight = rng.integers(0, 4, (800, 4)).astype(np.uint32), rng.integers(1, 4, 800)
        matrix[np.cumsum(matrix == 0, axis=1) > 0] = 0
        counts = Counter()
        for row, w in zip(matrix.tolist(), weight.tolist()):
            for k in range(1, 5):
                if row[k - 1]:
                    counts[tuple(row[:k])] += w
        found = [(tuple(matrix[row, :depth].tolist()), n) for row, depth, n in phrases.equal_parts(matrix, weight, least)]
        assert len(found) == len(dict(found)) and dict(found) == {p: n for p, n in counts.items() if n >= least}


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**11
    found = phrases.score_phrases(
        spark.createDataFrame([("en", "a b", big), ("en", "a", big + 1), ("en", "b", 2 * big)], "lang string, phrase string, n long"), spark.createDataFrame([("en", 10**13)], "lang string, n long")
    ).first()
    assert found["score"] == 1000 * big * 10**13 // ((big + 1) * 2 * big)
