import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from acrelens.llm import dac, packing, spm, words
from acrelens.llm.words import WordEncoder
from acrelens.scratch import scratch_path

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "a", "It's they'll DON'T 'tis", "x<|endoftext|>y <|startoftext|>", "É\u0301 ﬁ① Straße ΣΑΣ İstanbul", "日本語 テキスト", "a\u00a0b\u2003c\x1cd\x00e", "1234 5.6,7!?", "#" * 300, "🙂👩‍👩‍👧", "tab\tnew\nline\r\x0b\x0c.", "q" * 5000, "e\u0301le\u0300ve"]
ROWS = [(7, None, "c"), (3, "", "c")] + [(10 + i, t, "c") for i, t in enumerate(ODD)] + [(2, "Repeated rows of words", "c")] * 3 + [(None, "no id", "c"), (1, "Thing one and the other. " * 900, "c")]


def ids_by_library(text):
    return Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_remembered_words_give_the_librarys_ids():
    own = WordEncoder(WORDS)
    rng = random.Random(1)
    ends = [f"{stem}{mark}" for stem in ("aé", "İ", "Ƚİ", "×", "a÷", "9", "ß", "ɏ", "it's", "x'", "<|") for mark in ".,;:!?"]
    for text in ODD + [" ".join(ends)] + ["".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(33, 127), 32])) for _ in range(300)) for _ in range(200)]:
        assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == ids_by_library(text), repr(text)


def odd_texts(rng):
    """Words, marks, accents, signs and spaces side by side in every order."""
    bits = ["a", "Zé", "İ", "ß", "ɏ", "×", "÷", "ñ", "«", "e\u0301", "\u0338", "\u0301", "ﬁ", "日", "'", "'s", "'LL", ".", ",", "=", "<", "<|", "|>", "<|endoftext|>", "7", "&&", "\u00a0", "\x1c", " ", "\n", "\t", "  ", "the", "Otter"]
    return [None, *ODD, *["".join(rng.choice(bits) for _ in range(rng.randrange(0, 60))) for _ in range(400)], "", "end"]


@pytest.mark.parametrize("run", [words.RUN, 200, 1])
def test_many_texts_at_once_give_the_librarys_ids(run, monkeypatch):
    monkeypatch.setattr(words, "RUN", run)
    monkeypatch.setattr(words, "LIMIT", 50)
    monkeypatch.setattr(words, "ASKED", 3)
    texts = odd_texts(random.Random(5))
    for own in (WordEncoder(WORDS), WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))):
        rows = pa.array([None if t is None else t.encode() for t in ["first", *texts, "last"]], pa.binary()).slice(1, len(texts))
        found = [ids.tolist() for part in own.encode_all(rows) for ids in part]
        assert found == [[*own.tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
        assert list(own.encode_all(rows.slice(0, 0))) == []
        assert [ids.tolist() for part in own.encode_all(pa.nulls(2, pa.binary())) for ids in part] == [[1], [1]]


def test_words_of_many_texts_are_looked_up_once_and_without_their_marks():
    own, seen = WordEncoder(WORDS), []
    look_up = own._look_up
    own._look_up = lambda found: (seen.extend(found), look_up(found))[1]
    text = "otters, (otters) otters&&& Niño, niño niño. 'tis otters"
    assert len([ids for part in own.encode_all(pa.array([text.encode()] * 50)) for ids in part]) == 50
    assert sorted(map(bytes.decode, seen)) == sorted(["otters", ",", "(", ")", "&&&", "Niño", "niño", ".", "'tis"])


def test_another_tokenizer_is_not_taken_word_by_word():
    other = public_tokenizers.path("byte_bpe_50k.json")
    own = WordEncoder(other)
    assert WordEncoder(WORDS).wordwise and not own.wordwise
    for text in ODD:
        assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == [*Tokenizer.from_file(other).encode(text, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("top", [1, 200, 256, 40_000, 1 << 20, (1 << 32) - 1])
def test_codes_give_every_id_back_and_any_one_by_rank(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 7, 511, 512, 513, 5000):
        ids = (rng.random(n) ** 4 * top).astype(np.uint32)
        code = dac.Code(dac.pack(ids))
        assert code.all().tolist() == ids.tolist()
        assert [code[i] for i in range(n)] == ids.tolist()
        with pytest.raises(IndexError):
            code[n]


def test_token_files_hold_all_ids_in_order(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, ids string")
    path = scratch_path(spark, "files")
    dac.write(docs, path, WORDS, segment_ids=500)
    found = sorted(dac.read(spark, path).collect(), key=lambda r: r["start"])
    expected, start = [], 0
    for i, text, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):  # rows of equal doc_id are equal here
        ids = ids_by_library(text)
        expected.append((i, start, crc(ids)))
        start += len(ids)
    assert [(r["doc_id"], r["start"], zlib.crc32(r["ids"])) for r in found] == expected
    everything = np.frombuffer(b"".join(r["ids"] for r in found), "<u4")
    asked = spark.createDataFrame([(int(p),) for p in range(0, start, 37)], "position long")
    assert all(r["id"] == everything[r["position"]] for r in dac.lookup(spark, path, asked).collect())
    assert dac.lookup(spark, path, asked).count() == len(range(0, start, 37))
    repeated = spark.createDataFrame([(5,)] * 30 + [(start - 1,)], "position long")
    assert sorted(map(tuple, dac.lookup(spark, path, repeated, per_task=7).collect())) == [(5, everything[5])] * 30 + [(start - 1, everything[start - 1])]


def test_a_lookup_moves_the_codes_asked_for_only(spark):
    path = scratch_path(spark, "files")
    dac.write(spark.createDataFrame([(i, f"words of text {i} " * 40) for i in range(200)], "doc_id long, text string"), path, WORDS, segment_ids=300)
    assert dac.segments(spark, path).count() > 50
    places, codes = dac.placed(spark, path, spark.createDataFrame([(3,), (7,), (9000,)], "position long"), per_task=1)
    assert sorted((r["position"], r["turn"]) for r in places.collect())[:2] != [(3, 0), (7, 0)] and places.count() == 3
    assert codes.count() == 3  # two turns of one segment and one of another, of all those segments


def test_token_files_of_no_rows(spark):
    path = scratch_path(spark, "none")
    dac.write(spark.createDataFrame([], "doc_id long, text string"), path, WORDS)
    assert dac.read(spark, path).count() == 0


def test_packing_places_every_id_once_without_gaps(spark):
    rng = random.Random(2)
    rows = ROWS + [(100 + i, " ".join(rng.choice(["nation", "thing", "reader", "otter", f"w{i % 7}"]) for _ in range(rng.randrange(1, 900))), "c") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    found = packing.pack_documents(docs, WORDS, window=256, units_per_shard=40).collect()
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert len(r["ids"]) == 4 * r["length"] > 0
    wanted = {}
    for i, t, _ in rows:
        wanted.setdefault(i, []).append(ids_by_library(t))
    for i, texts in wanted.items():
        if len(texts) == 1:
            own = sorted(by_doc[i], key=lambda r: r["start"])
            assert np.frombuffer(b"".join(r["ids"] for r in own), "<u4").tolist() == texts[0]
            assert [r["start"] for r in own] == np.cumsum([0] + [r["length"] for r in own])[:-1].tolist()
            assert {r["doc_tokens"] for r in own} == {len(texts[0])}
        else:
            assert sum(r["length"] for r in by_doc[i]) == sum(map(len, texts))
    fills = []
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0] + [r["length"] for r in own])[:-1].tolist()
        fills.append(sum(r["length"] for r in own))
    shards = -(-len(rows) // 40)
    assert max(fills) <= 256 and sum(f < 256 for f in fills) <= 2 * shards
    assert packing.pack_documents(docs.limit(0), WORDS).count() == 0


def test_large_doc_ids_beside_null_ones_and_equal_rows_in_several_shards(spark):
    rows = [(2**60 + 1, "a large id"), (None, "none"), (2**53 + 1, "another")] + [(5, "equal rows of one id")] * 50
    found = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, window=64, units_per_shard=16).collect()
    assert {r["doc_id"] for r in found} == {2**60 + 1, None, 2**53 + 1, 5}
    assert sum(r["length"] for r in found if r["doc_id"] == 5) == 50 * len(ids_by_library("equal rows of one id"))
    assert len({r["sequence_id"] // 2 >> 16 for r in found}) >= 4
    named = packing.pack_documents(spark.createDataFrame([("x", "text ids")], "doc_id string, text string"), WORDS).collect()
    assert [r["doc_id"] for r in named] == ["x"]


def test_like_units_stand_in_one_shard():
    rng = np.random.default_rng(1)
    topics = [rng.choice(np.arange(20_000, 49_000), 3) for _ in range(40)]
    keys = sorted((packing._key(np.concatenate([rng.integers(2, 9_000, 150), t])), i) for i, t in enumerate(topics * 5))
    order = [i % 40 for _, i in keys]
    assert all(order[5 * k : 5 * k + 5].count(order[5 * k]) == 5 for k in range(40))
    assert packing._key(np.array([3], dtype="<u2")) == 3 << 32 and packing._key(np.array([3, 9], dtype="<u2")) == (9 << 16 | 3) << 16


def test_a_seeds_window_takes_its_nearest_neighbours():
    units = [np.array([5, 6, 7] * 10), np.array([50, 60, 70] * 10), np.array([5, 6, 9] * 10), np.array([51, 61] * 15)]
    placed = packing.pack_shard(units, np.ones(1 << 16), 30.0, 60)
    assert [p[0] for p in placed if p[3] == 0] == [0, 2]


def ranked_by_sorting(units, idf, mean_length, window):
    """The same packing with all free units sorted for every seed."""
    index = packing.ShardIndex(units, idf, mean_length)
    at, out, sequence = [0] * len(units), [], 0
    for seed in range(len(units)):
        if at[seed] == len(units[seed]):
            continue
        others = np.array([u for u in range(len(units)) if u != seed and at[u] < len(units[u])], dtype=np.int64)
        filled = 0
        for unit in [seed, *others[np.argsort(-index.scores(seed)[others], kind="stable")].tolist()]:
            take = min(window - filled, len(units[unit]) - at[unit])
            if take:
                out.append((unit, at[unit], at[unit] + take, sequence, filled))
            at[unit], filled = at[unit] + take, filled + take
        sequence += 1
    return out


def test_taking_the_nearest_one_by_one_packs_as_sorting_does():
    rng = np.random.default_rng(3)
    units = [rng.integers(0, 60, rng.integers(1, 64)).astype("<u2") for _ in range(150)] + [np.array([7], dtype="<u2")] * 90
    idf = rng.random(1 << 16).astype(np.float32)
    assert packing.pack_shard(units, idf, 30.0, 64) == ranked_by_sorting(units, idf, 30.0, 64)


def as_unigram(path):
    """The library's own model with its kind set to unigram, for the same Viterbi."""
    raw, at = bytearray(open(path, "rb").read()), 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while number() != 0x12:  # the trainer's settings are the model's field 2
        size = number()
        at += size
    number()
    while (tag := number()) != 0x18:  # the kind is their field 3
        skip = number()
        at += skip if tag & 7 == 2 else 0
    raw[at] = 1
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(raw))


def full_viterbi(own, text):
    best, back = [0.0], [0]
    for end in range(1, len(text) + 1):
        options = []
        for start in range(max(0, end - own.longest), end):
            found = own.ids.get(text[start:end]) or ((0, own.unknown) if end - start == 1 else None)
            if found:
                options.append((best[start] + found[1], -start))
        score, start = max(options)
        best.append(score)
        back.append(-start)
    out, end = [], len(text)
    while end:
        piece = text[back[end] : end]
        out.append([own.ids[piece][0]] if piece in own.ids else [own.byte_ids[b] for b in piece.encode()])
        end = back[end]
    return [i for part in reversed(out) for i in part]


def test_streaming_viterbi_is_the_full_viterbi(spark):
    own = spm.Pieces(PIECES)
    rng = random.Random(3)
    texts = [t for t in ODD if t] + ["thing" * 400, "ab" * 700, "  two  spaces ", "\n\n a", "日" * 100]
    texts += ["".join(rng.choice("theinorasd  é,.\n") for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    for text in texts:
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        assert ids == full_viterbi(own, (" " + text).replace(" ", spm.SPACE)), repr(text)
        assert list(own.viterbi((" " + text).replace(" ", spm.SPACE))) == ids
        assert own.decode(own.encode(text)) == text
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, ids string")
    both = spm.encode_and_decode(docs, PIECES).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in both) == sorted((i or 0, t or "") for i, t, _ in ROWS)
    assert sorted(map(str, spm.decode(spm.encode(docs, PIECES), PIECES).collect())) == sorted(str(r) for r in spm.encode_and_decode(docs, PIECES).select("doc_id", "text").collect())


def test_viterbi_agrees_with_the_library():
    own, library = spm.Pieces(PIECES), as_unigram(PIECES)
    rng = random.Random(4)
    for _ in range(200):
        text = " ".join("".join(rng.choice("theinorasdmpl") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 20)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text)
