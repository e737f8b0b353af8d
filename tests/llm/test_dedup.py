import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from acrelens.llm import components, exact_dedup, simhash

WORDS = "the an is of thing nation eat tree ready sing are feel over onto item rest".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(rng):
    texts = [None, "", "", " ", "\t\n", "a", "a b", "a  b", "a\tb", "b a " * 4000]
    long = [prose(rng, rng.randrange(1, 1500)) for _ in range(12)]
    texts += long + [t.replace(" ", "\n", 3) for t in long[:5]] + [long[0] + "x", "x" + long[0], "é" * 9000, "é" * 9000 + "ö"]
    texts += [long[1]] * 40
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    return rows + [(3, texts[3], "y"), (None, long[2], "z"), (None, "only", "z")]


def exact_by_hand(rows):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(norm(t), []).append(i)
    out, seen = [], set()
    for i, t, _ in rows:
        own = groups[norm(t)]
        keep = min((x for x in own if x is not None), default=None)
        stays = i == keep and norm(t) not in seen
        if stays:
            seen.add(norm(t))
        out.append((i, keep, len(own), stays, hashlib.sha256(norm(t).encode()).hexdigest()))
    return out


def by_text(rows):
    return sorted(map(tuple, rows), key=str)


def test_exact_groups_match_brute_force_whatever_the_hash(spark):
    rows = corpus(random.Random(1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    expected = by_text(exact_by_hand(rows))
    assert by_text(exact_dedup.exact_groups(docs).collect()) == expected
    assert by_text(exact_dedup.exact_groups(docs, lambda c: F.pmod(F.xxhash64(c), F.lit(3))).collect()) == expected


def test_chunks_are_the_text_and_follow_an_insertion(spark):
    text = prose(random.Random(2), 4000)
    df = spark.createDataFrame([(text,), ("new words in front " + text,)], "t string")
    a, b = [r[0] for r in df.select(exact_dedup.chunks(F.col("t"))).collect()]
    assert "".join(a) == text and max(map(len, a)) <= exact_dedup.MAX_CHUNK
    assert len(set(a) & set(b)) > len(a) / 2


def test_exact_copies_are_dropped_and_columns_stay(spark):
    rows = corpus(random.Random(3))
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert told_exact(kept) == wanted_exact(rows)
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0 and exact_dedup.drop_exact_copies(docs.limit(0)).count() == 0


def told_exact(kept):
    return sorted((str(r["doc_id"]), " ".join((r["text"] or "").split())) for r in kept.collect())


def wanted_exact(rows):
    return sorted((str(i), " ".join((t or "").split())) for (i, t, *_), told in zip(rows, exact_by_hand(rows)) if told[3])


REPEATED = [
    (1, "alpha beta", "x"), (5, "alpha beta", "x"), (5, "a unique text of its own", "x"), (7, "same row", "x"), (7, "same row", "x"), (7, "same  row", "y"),
    (2**60 + 1, "alpha beta", "x"), (2**60 + 1, "far away", "x"), (None, "alpha beta", "x"), (None, "nobody's", "x"), (None, "nobody's", "x"),
]


def test_copies_are_dropped_row_by_row(spark):
    docs = spark.createDataFrame(REPEATED, "doc_id long, text string, mark string").selectExpr("*", "mark as row", "mark as `a.b`", "map(mark, 1) as m")
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert told_exact(kept) == wanted_exact(REPEATED)
    assert len(wanted_exact(REPEATED)) == 5
    fps = [fingerprint_by_hand(t) for _, t, _ in REPEATED]
    best = {}
    for (i, t, _), root in zip(REPEATED, components_by_hand(fps)):
        best[root] = min(best.get(root, (2**62, "")), (2**61 if i is None else i, " ".join(t.split())))
    near = simhash.drop_near_copies(docs)
    assert near.columns == docs.columns
    assert sorted((2**61 if r["doc_id"] is None else r["doc_id"], " ".join(r["text"].split())) for r in near.collect()) == sorted(best.values())
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0


def fingerprint_by_hand(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components_by_hand(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_matches_brute_force_with_and_without_crowded_blocks(spark):
    rng = random.Random(4)
    texts = [None, "", "a", "A", "a b", "É a", "x " * 5000]
    for _ in range(15):
        words = prose(rng, rng.randrange(150, 600)).split()
        for _ in range(6):
            texts.append(" ".join(words))
            words = words[:]
            words[rng.randrange(len(words))] = "other" + str(rng.random())
    rows = [(i * 3, t, "q") for i, t in enumerate(texts)] + [(None, "a", "q"), (6, "a", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    fps = [fingerprint_by_hand(t) for _, t, _ in rows]
    roots = components_by_hand(fps)
    least = {}
    for (i, _, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    expected = by_text((i, f"{f:016x}", least.get(r)) for (i, _, _), f, r in zip(rows, fps, roots))
    for limit in (0, 2, 32):
        assert by_text(simhash.near_duplicates(docs, limit).collect()) == expected
    kept = sorted(r["doc_id"] for r in simhash.drop_near_copies(docs).collect())
    assert kept == sorted(least[r] for r in set(roots))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_of_a_cloud_of_fingerprints(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = sorted({base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(8)) for _ in range(300)})
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
    assert len(edges) < 65 * len(fps)
    roots = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    by_hand = components_by_hand(fps)
    groups = lambda names: sorted(sorted(i for i in range(len(fps)) if names[i] == n) for n in set(names))
    assert groups([roots.get(s, s) for (s,) in signed]) == groups(by_hand)


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (2000, 2001), (2001, 2000)]
    found = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert all(found[i] == 0 for i in range(61)) and all(found[i] == 1000 for i in range(1000, 1100)) and found[2001] == 2000
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
