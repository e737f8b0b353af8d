import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tests.llm.test_dedup import components_by_hand, exact_by_hand, fingerprint_by_hand
from tests.llm.test_substring import by_hand
from tests.llm.test_toxicity import sentence


def corpus():
    rng = random.Random(1)
    docs = [". ".join(sentence(rng, i % 4 == 0) for _ in range(rng.randrange(2, 9))) for i in range(240)]
    passage = " ".join(sentence(rng, False) for _ in range(6))
    docs[31:40] = [f"{d} {passage} {e}" for d, e in zip(docs[31:40], docs[51:60])]
    docs += [docs[1], docs[2].replace(" ", "\n"), docs[35], "", None, ""]
    near = docs[3] * 40
    docs += [near, near + " end"]
    rows = [(i, d, "en", "src", len(d or "")) for i, d in enumerate(docs)]
    return rows, [(i, 1, int(i % 4 == 0)) for i in range(240)]


def test_every_stage_against_brute_force(spark, tmp_path):
    rows, labels = corpus()
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, texts, names = docs.columns, [], [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_dedup", "substring_dedup", "packing"]
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf).write.parquet(f"{sf}/stage{k}")
        now = spark.read.parquet(f"{sf}/stage{k}")
        if k < 4:
            assert now.columns == columns
            texts.append({r["doc_id"]: r["text"] for r in now.collect()})
    toxic = {i for i, _, t in labels if t}
    assert len(toxic & set(texts[0])) <= 2 and len(texts[0]) >= len(rows) - len(toxic) - 2
    three = lambda d: [(i, t, "") for i, t in d.items()]
    assert set(texts[1]) == {r[0] for r in exact_by_hand(three(texts[0])) if r[3]}
    ids = sorted(texts[1])
    roots = components_by_hand([fingerprint_by_hand(texts[1][i]) for i in ids])
    assert set(texts[2]) == {min(i for i, r in zip(ids, roots) if r == root) for root in set(roots)}
    removed = {i: n for i, _, n, _ in by_hand(three(texts[2]), 50)}
    assert sum(n > 0 for n in removed.values()) >= 7
    for i, before in texts[2].items():
        assert texts[3][i] == before if removed[i] == 0 else len(texts[3][i].split()) == len(before.split()) - removed[i]
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    pieces = {}
    for r in now.collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(texts[3])
    for i, own in pieces.items():
        n = len(encode(texts[3][i] or "", add_special_tokens=False).ids) + 1
        assert {r["doc_tokens"] for r in own} == {n} and sum(r["length"] for r in own) == n
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, now.collect()))


def test_registered_queries(spark):
    found = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in found if q.startswith("op") and q[2].isdigit()}
    assert "pipeline" in found and set(__spark_entry__.oracle_sql()) <= set(found)
    assert np.all([callable(f) for f in found.values()])
