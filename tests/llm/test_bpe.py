import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from acrelens.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(3)
    letters = [*"ab '’st\n\t  reÀÉ.,!12", "<|endoftext|>", "<|end", "  ", "　", "\x1c", "日本", "\U0001f642", "'ll", "'S", "́", " ", "\x00"]
    some = ["".join(rng.choice(letters) for _ in range(rng.randrange(70))) for _ in range(1500)]
    return some + ["", "a" * 20_001, "ab" * 30_000, " " * 5000 + "x", "\n" * 3001, "é" * 7000, "<|endoftext|><|endoftext|>", "word " * 100_000]


def test_equals_the_library(spark, library):
    rows = [(i, t, "doc", "x") for i, t in enumerate(texts())]
    rows += [(None, "a null id", "", ""), (7, None, "", ""), (7, "twice", "", ""), (7, "twice", "", "")]
    got = sorted(map(tuple, bpe.digest(spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string"), PATH).collect()), key=str)
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_round_trip_of_columns(spark):
    rows = [(str(i), t) for i, t in enumerate(texts())] + [("none", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    assert back == {i: t or "" for i, t in rows}


def test_decoding_bytes_that_are_no_text(spark, library):
    ids = [i for i in range(0, 50257, 97)] + [50256, 220, 128, 200]
    rows = [(1, np.array(ids, dtype="<u4").tobytes()), (2, None), (3, b"")]
    got = dict(map(tuple, bpe.decode(spark.createDataFrame(rows, "doc_id long, ids binary"), PATH).collect()))
    assert got == {1: library.decode(ids, skip_special_tokens=False), 2: "", 3: ""}


def test_what_is_remembered_makes_no_difference(library, monkeypatch):
    monkeypatch.setattr(bpe, "LIMIT", 50)
    own, some = bpe.Merges(PATH), texts()[:600]
    for at in range(0, len(some), 40):
        for text, ids in zip(some[at : at + 40], own.encode(some[at : at + 40])):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(own.before) and len(own) < 3000


@pytest.mark.parametrize("many", [1, 3, 10**9])
def test_many_positions_at_once_or_one_by_one(library, monkeypatch, many):
    monkeypatch.setattr(bpe, "MANY", many)
    own, some = bpe.Merges(PATH), texts()
    for text, ids in zip(some, own.encode(some)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("many", [1, 64])
def test_ranks_that_do_not_rise(tmp_path, monkeypatch, many):
    """A merge whose parts come later than itself: the lowest rank at hand goes first, as in the library."""
    monkeypatch.setattr(bpe, "MANY", many)
    told = json.load(open(PATH))
    vocabulary = {c: i for i, c in enumerate([k for k, v in sorted(told["model"]["vocab"].items(), key=lambda x: x[1]) if len(k) == 1])}
    for token in ("abc", "ab", "bc", "abab", "aba", "aa", "aaa"):
        vocabulary[token] = len(vocabulary)
    told["model"] |= {"vocab": vocabulary, "merges": [["ab", "c"], ["ab", "ab"], ["b", "c"], ["a", "b"], ["ab", "a"], ["a", "a"], ["aa", "a"]]}
    told["added_tokens"] = []
    path = str(tmp_path / "own.json")
    json.dump(told, open(path, "w"))
    own, library = bpe.Merges(path), Tokenizer.from_file(path)
    rng = random.Random(1)
    for text in ["".join(rng.choice("abc ") for _ in range(rng.randrange(30))) for _ in range(2000)]:
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        bpe.Merges(public_tokenizers.path("word_bpe_49k.json"))


def test_no_rows(spark):
    assert bpe.digest(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
