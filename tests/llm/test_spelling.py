import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import common, spelling
from siltstone.llm.common import table


def words_of(rows, damaged):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if damaged and h % damaged == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    """Exactly one code point inserted, deleted or replaced: what is left between the longest common ends."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def brute(rows, damaged=97):
    n = words_of(rows, damaged)
    holes = {}
    for w in n:  # words that are near agree once a code point of one, or of both, is gone
        for x in {w} | {w[:k] + w[k + 1 :] for k in range(len(w))}:
            holes.setdefault(x, []).append(w)
    beside = {w: set() for w in n}
    for group in holes.values():
        for a in group:
            beside[a].update(b for b in group if near(a, b))
    form = {}
    for w, others in beside.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(beside[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op11_whole_table(spark, sf):
    want = brute([(r.doc_id, r.text) for r in table(spark, f"/root/testdata/{sf}", "documents").select("doc_id", "text").collect()])
    assert len(want) > 1000 and any(r[1] for r in want) and any(r[2] != r[1] and r[1] for r in want)
    assert got(spelling.op11_spelling_variants(spark, f"/root/testdata/{sf}")) == want


ODD = [(1, None), (2, ""), (3, "12 34 -"), (None, "aaaaa aaaaa aaaab"), (None, "aaaab aaaab"), (5, "Straße straße STRAßE strasse STRASSE strasse straßen"), (5, "Straße straße STRAßE strasse STRASSE strasse straßen"), (6, "Éclair éclair Éclair éclair Éclair éclair eclair eclair eclair éclair"), (7, " ".join(["e" * 3000, "e" * 2999, "e" * 2998 + "x"] * 3)), (8, "abcd abcd abcd abcdx abcdx abcdx\nabcdx abcdx×abcd abcdyabcde abcde abcde"), (9, "chain chain chain " + "chainx " * 6 + "chainxy " * 12 + "chainxyz " * 24)]


@pytest.mark.parametrize("damaged", [None, 3, 97])
@pytest.mark.parametrize("small", [False, True])
def test_op11_odd_rows(spark, monkeypatch, damaged, small):
    if small:  # many slices and tasks, a filter that is nearly full, joins beyond the broadcast bound
        for name, value in {"AT_ONCE": 500, "TASK_WORDS": 2, "LEAST_BITS": 1 << 16, "MOST_BITS": 1 << 16}.items():
            monkeypatch.setattr(spelling, name, value)
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in ODD], "doc_id long, text string, word string, n int")
    assert got(spelling.variants(df, damaged=damaged)) == brute(ODD, damaged)


def test_op11_random_words(spark):
    rnd = random.Random(5)
    rows = [(k, " ".join("".join(rnd.choice("abÀ") for _ in range(rnd.randint(4, 8))) for _ in range(300))) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(spelling.variants(df, damaged=7)) == brute(rows, 7)


def test_op11_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(df).count() == 0


def test_neighbours_are_distinct_and_all():
    alphabet = "abc"
    points = np.frombuffer(alphabet.encode("utf-32-le"), np.uint32)
    for word in ("aabca", "ccccc", "abcab"):
        codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).reshape(1, -1)
        found, hashed = [], []
        for edit, _, place, letter, h in spelling.neighbours(codes, points):
            found += [spelling._edited(edit, word, p, alphabet[c]) for p, c in zip(place.tolist(), letter.tolist())]
            hashed += h.tolist()
        want = {word[:k] + word[k + 1 :] for k in range(5)} | {word[:k] + c + word[k + 1 :] for k in range(5) for c in alphabet} | {word[:k] + c + word[k:] for k in range(6) for c in alphabet}
        assert sorted(found) == sorted(want - {word})
        assert hashed == spelling.hashes(found).tolist()
