import random
import re
import zlib
from collections import Counter

from acrelens.llm import spelling
from acrelens.scratch import Workspace

SCHEMA = "doc_id long, text string, lang string, word string"


def words_by_hand(rows):
    total = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def near_by_hand(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def by_hand(counts):
    rows, form = [], {}
    for w, n in counts.items():
        near = [(-counts[v], v) for v in counts if near_by_hand(w, v)]
        if near and -min(near)[0] >= 10 * n:
            form[w] = min(near)[1]
        rows.append((w, n, len(near)))
    out = []
    for w, n, n_near in rows:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, n_near, counts[form[w]] if w in form else None))
    return sorted(out)


def variants(spark, rows, **settings):
    docs = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.variants(docs, **settings).collect())


def corpus():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(7, 12))) for _ in range(25)]
    base += ["aaaaaaa", "aaaaaaaa", "abababab", "bababab", "abababa"]
    rows = []
    for i in range(260):
        some = []
        for _ in range(60):
            w = base[min(int(rng.expovariate(0.15)), len(base) - 1)]
            if rng.random() < 0.2:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abcdeé") + w[at:], w[:at] + rng.choice("abcdeé") + w[at + 1 :]])
            some.append(w if rng.random() < 0.8 else w.upper())
        rows.append((i, " ".join(some), "en", "x"))
    return rows + [(None, "abababab-abababab", None, None), (900, None, "en", ""), (901, "", "en", ""), (3, rows[3][1], "en", ""), (3, rows[3][1], "en", "")]


def test_equals_brute_force_whatever_the_shards(spark):
    rows = corpus()
    want = by_hand(words_by_hand(rows))
    assert sum(r[1] is not None for r in want) > 20 and len(want) > 300
    for segments in (20_000, 40, 3):  # the last two split segments into parts
        assert variants(spark, rows, segments=segments) == want


def test_chains_of_forms(spark):
    counts = [("steplon", 2), ("steplonx", 20), ("steplonxy", 200), ("steplonxyz", 2000), ("unlikely", 7), ("unlikelyx", 69), ("equalone", 30), ("equaltwo", 40), ("tieeeeaa", 2), ("tieeeeab", 20), ("tieeeeaé", 20)]
    docs = [(1, " ".join(f"{w} " * n for w, n in counts), "en", "")]
    got = variants(spark, docs)
    counts = words_by_hand(docs)
    assert got == by_hand(counts)
    by_word = {r[0]: r for r in got}
    if {"steplon", "steplonx", "steplonxy", "steplonxyz"} <= set(counts):
        assert by_word["steplon"][1:3] == ("steplonx", "steplonxyz")


def test_long_texts_and_runs(spark, monkeypatch):
    rng = random.Random(2)
    long = "".join(rng.choice("abc") for _ in range(300_000))
    other = long[:200_000] + long[200_001:]
    many = " ".join(rng.choice(["wordlike", "wordliker", "wörldlike"]) for _ in range(200_000))
    rows = [(1, long, "", ""), (2, long, "", ""), (3, other, "", ""), (4, other, "", ""), (5, many, "", "")]
    counts = words_by_hand(rows)
    got = variants(spark, rows)
    assert got == by_hand(counts)
    assert [r[4] for r in got if len(r[0]) > 1000] and len(rows[4][1]) > spelling.STRETCH


def test_stretches_end_between_runs(monkeypatch):
    monkeypatch.setattr(spelling, "STRETCH", 5)
    for text in ("abc def ghijklmnop q", "abcdefghijk", "ab  ", "", "....a....b", "àéÿ×÷ b"):
        assert [r for some in spelling.runs(text) for r in some] == re.findall("[A-Za-zÀ-ÿ]+", text)


def test_no_rows_and_no_words(spark):
    assert variants(spark, []) == []
    assert variants(spark, [(1, "a few words", "", ""), (2, None, "", "")]) == []


def test_no_rows_per_pair(spark):
    """What leaves the automata is a row per word and part, however many words are near each other."""
    words = [f"crowded{a}{b}" for a in "abcdefghijklmnop" for b in "abcdefghijklmnop"]
    counted = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = spelling.near_words(counted, Workspace(spark, "test"), 50).collect()
    assert {r["n_near"] for r in got} == {30} and len(got) == 256
