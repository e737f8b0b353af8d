import hashlib
import random
import re

import pytest

from acrelens.llm import substring


def by_hand(rows, window):
    split = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]
    first = {}
    for i, t, _ in rows:
        words = split(t)
        if i is not None:
            for s in range(len(words) - window + 1):
                key = tuple(words[s : s + window])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, t, _ in rows:
        words = split(t)
        gone = set()
        for s in range(len(words) - window + 1):
            if i is not None and first[tuple(words[s : s + window])] < i:
                gone.update(range(s, s + window))
        kept = " ".join(w for p, w in enumerate(words) if p not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(rng):
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "été", "Zeta,"]) + str(rng.randrange(9))
    prose = lambda n: [word() for _ in range(n)]
    passages = [prose(n) for n in (50, 51, 60, 120, 49, 300)]
    rows = [(1, None, "x"), (2, "", "x"), (3, " ".join(["same"] * 400), "x"), (4, "\n".join(["same"] * 120), "x")]
    for i in range(10, 60):
        words = prose(rng.randrange(0, 150))
        for _ in range(rng.randrange(3)):
            words += rng.choice(passages) + prose(rng.randrange(0, 80))
        rows.append((i, " ".join(words), "x"))
    rows += [(i, rows[20][1], "x") for i in (0, 70, 71)] + [(72, rows[30][1] + " more", "x"), (None, rows[30][1], "x"), (73, " ".join(passages[5] * 2), "x"), (73, " ".join(passages[5]), "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("batches", "max_runs"), [(1, 1), (4, 2)])
def test_removed_words_match_brute_force(spark, batches, max_runs):
    rows = corpus(random.Random(batches))
    docs = spark.createDataFrame(rows, "doc_id long, text string, t string")
    found = substring.deduplicate(docs, batches=batches, max_runs=max_runs).collect()
    assert told(found) == by_hand(rows, 50)
    assert {r["row"]["t"] for r in found} == {"x"}


def told(found):
    return sorted(((r["row"]["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in found), key=str)


def test_a_later_job_reopens_the_index(spark, tmp_path):
    rows = [r for r in corpus(random.Random(9)) if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t string")
    parts = [docs.filter("doc_id < 25"), docs.filter("doc_id between 25 and 45"), docs.filter("doc_id > 45")]
    found = []
    for i, part in enumerate(parts):
        session = spark.newSession()
        index = substring.FingerprintIndex(session, f"{tmp_path}/index")
        assert index.version == i and (len(index.runs["spans"]) > 0) == (i > 0)
        earlier = docs.filter("doc_id < 25" if i == 1 else "doc_id <= 45") if i else None
        found += substring.deduplicate(part, batches=1 + i % 2, index=index, earlier=earlier).collect()
    assert told(found) == by_hand(rows, 50)
    assert sum(r["n_removed"] > 0 for r in found) > 10


def test_texts_that_are_needed_must_be_there(spark, tmp_path):
    rng = random.Random(3)
    prose = lambda n: " ".join(str(rng.random()) for _ in range(n))
    passage = prose(60)
    old = [(1, f"{prose(20)} {passage} {prose(20)}", "x"), (2, prose(100), "x")]
    new = [(9, f"{prose(30)} {passage} {prose(30)}", "x")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, t string")
    for earlier in (None, frame(old[1:])):
        path = f"{tmp_path}/{earlier is None}"
        substring.deduplicate(frame(old), batches=1, index=substring.FingerprintIndex(spark, path))
        with pytest.raises(ValueError, match="earlier"):
            substring.deduplicate(frame(new), batches=1, index=substring.FingerprintIndex(spark, path), earlier=earlier)
        index = substring.FingerprintIndex(spark, path)
        found = substring.deduplicate(frame(new), batches=1, index=index, earlier=frame(old)).collect()
        assert [r["n_removed"] for r in found] == [60]


def test_ids_of_text_and_long_texts(spark):
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300_000))
    rows = [("b", long, "x"), ("a", "some other words " + long[: len(long) // 2], "x"), ("c", "word " * 20, "x"), (None, long, "x")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, t string")
    assert told(substring.deduplicate(docs).collect()) == by_hand(rows, 50)


def test_old_texts_are_not_read_without_need(spark, tmp_path):
    rng = random.Random(2)
    old = [(i, " ".join(str(rng.random()) for _ in range(90)), "x") for i in range(5)]
    new = [(9, old[1][1], "x"), (10, "other " * 90, "x")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, t string")
    substring.deduplicate(frame(old), batches=1, index=substring.FingerprintIndex(spark, f"{tmp_path}/index"))
    index = substring.FingerprintIndex(spark, f"{tmp_path}/index", max_runs=0)
    index.compact()  # a job that ends here leaves the index as it was
    index = substring.FingerprintIndex(spark, f"{tmp_path}/index", max_runs=0)
    found = substring.deduplicate(frame(new), batches=1, index=index)
    assert told(found.collect()) == [r for r in by_hand(old + new, 50) if r[0] > 8]
    assert index.known("opened").count() == 0


def test_texts_that_lose_nothing_stay_as_they_are(spark):
    rows = [(1, "a  b\nc", "x"), (2, "word " * 60, "y"), (3, "word " * 55 + "end", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, covered string")
    assert sorted(map(tuple, substring.drop_repeated_passages(docs).collect())) == [rows[0], rows[1], (3, "end", "z")]
    assert substring.digest(docs.limit(0)).count() == 0
    clashing = docs.selectExpr("doc_id", "text", "covered as row", "covered as t", "covered as n_removed", "covered as kept", "covered as bit", "covered as `a.b`")
    assert sorted(map(tuple, substring.drop_repeated_passages(clashing).collect())) == [(*rows[0], *"xxxxx"), (*rows[1], *"yyyyy"), (3, "end", *"zzzzzz")]
