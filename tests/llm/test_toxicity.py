import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from acrelens.llm import toxicity

INSULTS = ["idiot", "worthless", "scumbag", "pathetic"]
SYLLABLES = "the an er ing on at es to re nd ion ly st or en".split()


def sentence(rng, toxic):
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(12)]
    if toxic:
        words[rng.randrange(12)] = rng.choice(INSULTS)
        words[rng.randrange(12)] = rng.choice(INSULTS) + ","
    return " ".join(words)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        rows.append((i, ". ".join(sentence(rng, toxic and rng.random() < 0.7 or toxic and s == 0) for s in range(3)), "x"))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def by_hand_kernel(a, b):
    def phi(u):
        out = {}
        for i in range(len(u)):
            for j in range(i + 1, len(u)):
                for k in range(j + 1, len(u)):
                    if k - i < toxicity.SPAN:
                        key = tuple(toxicity._code(u[x]) for x in (i, j, k))
                        out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i - 2)
        return out

    x, y = phi(a), phi(b)
    dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5


def test_features_are_the_subsequence_kernel():
    for a, b in [("idiot", "idiot"), ("idiot", "id-io.t"), ("banana", "ananas"), ("été", "ete"), ("worthless", "wort_hless")]:
        z = toxicity._dense([b])
        assert np.isclose(toxicity._products([a], z)[0, 0], by_hand_kernel(a, b))
    assert by_hand_kernel("idiot", "idxiot") > 0.5


def test_held_out_accuracy_and_gapped_insults(spark, tables):
    docs, labels = tables
    machine = toxicity.fit(docs, labels)
    found = {r["doc_id"]: r for r in toxicity.judge(docs, labels).collect()}
    assert len(found) == 900
    for i, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in found.values() if r["held_out"]]
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 == 0) for r in held]) > 0.95
    margins = machine.margins(["idiot", "idi.ot", "id-iot", "wort*hless", "thering", "ationly", "st"])
    assert min(margins[u] for u in ("idiot", "idi.ot", "id-iot", "wort*hless")) > max(margins[u] for u in ("thering", "ationly", "st"))
    assert "idiot" in toxicity.units("you i d i o t there")[1]


def test_odd_rows_and_missing_labels(spark, tables):
    docs, labels = tables
    odd = docs.unionByName(spark.createDataFrame([(None, "a", "x"), (5000, None, "x"), (5001, "", "x"), (5002, "z" * 70000, "x"), (5003, "the tionand er " * 40000 + "idiot " * 9000, "x"), (1, "again", "x")], docs.schema))
    rows = toxicity.judge(odd, labels).collect()
    assert len(rows) == 906 and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["predicted"] for r in rows if r["doc_id"] == 5003] == [1]
    kept = toxicity.drop_toxic(odd, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in rows if r["predicted"] == 0} == {r["doc_id"] for r in kept.collect()}
    one_kind = toxicity.judge(docs, labels.filter("toxic = 0")).collect()
    assert {r["score"] for r in one_kind} == {0.0}
    assert toxicity.judge(docs.limit(0), labels).count() == 0


def test_what_comes_to_the_driver_is_bounded(spark, monkeypatch):
    """Repeated doc_ids give no more rows than documents are asked for, and no part of a long sentence is left out."""
    rng = random.Random(4)
    docs = [(i % 10, f"{sentence(rng, i % 2 == 0)}. {sentence(rng, False)}", "x") for i in range(1000)]
    labels = [(i, 1, int(i % 2 == 0)) for i in range(10)]
    frames = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    sizes = []
    logistic = toxicity._logistic
    monkeypatch.setattr(toxicity, "_logistic", lambda x, y, *a: sizes.append(len(x)) or logistic(x, y, *a))
    toxicity.fit(*frames, train_docs=10, calibration_docs=10)
    assert sizes == [10]


def test_long_sentences_are_cut_between_words(spark):
    long = " ".join(f"word{i}" for i in range(300)) + " " + "x" * 1000 + "  end"
    parts = spark.createDataFrame([(long,)], "s string").select(F.explode(F.regexp_extract_all("s", F.lit(toxicity._STRETCH), F.lit(0))).alias("p")).collect()
    parts = [r["p"] for r in parts]
    assert max(map(len, parts)) <= toxicity.SENTENCE_CHARS and "".join("".join(parts).split()) == "".join(long.split())
    assert {w for p in parts for w in p.split() if not w.startswith("x")} == {*(f"word{i}" for i in range(300)), "end"}
