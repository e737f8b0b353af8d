import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from acrelens.llm import audit

DOCS = "doc_id long, text string, lang string, mask int, quality int"
LABELS = "doc_id long, quality int, toxic int, part string"


def masks_by_hand(rows):
    least = {}
    for doc_id, text, *_ in rows:
        key = (doc_id is None, doc_id or 0)
        least[text or ""] = min(key, least.get(text or "", key))
    out = []
    for doc_id, text, lang, *_ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = ""
        fails += "A" * (len(words) < 200)
        fails += "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t))
        fails += "D" * bool(re.search(r"[#$%&*|]", t))
        fails += "E" * (least[t] < (doc_id is None, doc_id or 0))
        out.append((doc_id, lang or "", fails))
    return out


def by_hand(rows, labels):
    good = {i for i, q, _, _ in labels if q == 1}
    toxic = {i for i, _, t, _ in labels if t == 1}
    judged = masks_by_hand(rows)
    out = []
    for part in {p for _, p, _ in judged}:
        own = [(i, f) for i, p, f in judged if p == part]
        steps = []
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                early = set(order[: step - 1])
                here = [(i, f) for i, f in own if not early & set(f) and letter in f]
                steps.append((order, step, letter, sum(not early & set(f) and letter not in f for _, f in own), len(here), sum(letter in f for _, f in own) - len(here), sum(f == letter for _, f in own), sum(i is not None and i in good for i, _ in here), sum(i is not None and i in toxic for i, _ in here)))
        for order, step, letter, kept, removed, *rest in steps:
            out.append((part, order, step, kept, removed, *rest, sum(s[4] for s in steps if s[2] == letter)))
    return sorted(out)


def interactions(spark, rows, labels, **settings):
    out = audit.interactions(spark.createDataFrame(rows, DOCS).repartition(5), spark.createDataFrame(labels, LABELS), **settings)
    assert ", ".join(f"{n} {t}" for n, t in out.dtypes) == audit.REPORT.replace("long", "bigint")
    return sorted(map(tuple, out.collect()))


def corpus():
    rng = random.Random(9)
    rows = []
    for i in range(150):
        n = rng.choice([0, 1, 150, 199, 200, 201, 400])
        words = [rng.choice(["one", "Two", "three", "vier", "Été"]) if rng.random() < 0.5 else f"w{rng.randrange(600)}" for _ in range(n)]
        words += ["#"] * (rng.random() < 0.2) + ["LOUD" * 20] * (rng.random() < 0.2)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words), rng.choice(["en", "de", None, ""]), 1, 1))
    hot = " ".join(f"copy{j}" for j in range(220))
    rows += [(200 + i, hot, rng.choice(["en", "de"]), 0, 0) for i in range(120)]
    rows += [(i, rows[i % 7][1], "fr", 0, 0) for i in range(400, 440)]
    rows += [(None, hot, "en", 0, 0), (None, "only here", "en", 0, 0), (None, "only here", "en", 0, 0), (500, None, "en", 0, 0), (501, "", "en", 0, 0), (200, hot, "de", 0, 0), (200, hot, "de", 0, 0), (3, "another text of the same id", None, 0, 0)]
    labels = [(i, rng.randrange(2), rng.randrange(2), "") for i in range(0, 450, 2)] + [(4, 1, None, ""), (4, None, 1, ""), (None, 1, 1, ""), (9999, 1, 1, "")]
    return rows, labels


def test_equals_brute_force(spark):
    rows, labels = corpus()
    want = by_hand(rows, labels)
    assert interactions(spark, rows, labels) == want and len(want) == 600 * 4


def test_any_fingerprint_gives_the_same(spark):
    rows, labels = corpus()
    want = by_hand(rows, labels)
    assert interactions(spark, rows, labels, hash_text=lambda t: F.lit(7).cast("long")) == want
    assert interactions(spark, rows, labels, hash_text=lambda t: F.length(t).cast("long") % 3) == want


def test_chains_given_out_early(spark):
    import pyarrow as pa

    rows, _ = corpus()
    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "part": [r[2] or "" for r in rows], "fp": [1] * len(rows), "shared": [True] * len(rows), "text": [(r[1] or "").encode() for r in rows]})
    held, audit.HELD_BYTES = audit.HELD_BYTES, 1
    try:
        some = [r for b in audit._first_chains(iter([batch.slice(i, 9) for i in range(0, len(rows), 9)]), pa.int64()) for r in b.to_pylist()]
    finally:
        audit.HELD_BYTES = held
    sent = sorted((((r["fp"], *audit._after(r["doc_id"])), (r["doc_id"], r["part"], r["mask"], r["n"], r["text"])) for r in some if r["fp"] is not None), key=lambda x: x[0])
    told = [(r["doc_id"], r["part"], r["mask"], r["n"]) for r in some if r["fp"] is None] + list(audit._chains(iter(sent)))
    got = sorted(((i, p, "".join(f for k, f in enumerate("ABCDE") if m >> k & 1)) for i, p, m, n in told for _ in range(n)), key=str)
    assert got == sorted(masks_by_hand(rows), key=str)


def test_no_rows(spark):
    assert interactions(spark, [], [(1, 1, 1, "")]) == []
    assert len(interactions(spark, [(1, None, None, 0, 0)], [])) == 600


def test_a_very_long_text_twice(spark):
    long = "word # " * 700_000
    rows = [(1, long, "en", 0, 0), (2, long, "en", 0, 0)]
    assert interactions(spark, rows, []) == by_hand(rows, [])


def test_ids_of_text(spark):
    docs = spark.createDataFrame([("b", "x", "en"), ("a", "x", "en"), (None, "x", "en")], "doc_id string, text string, lang string")
    got = {r["doc_id"]: r["mask"] for r in audit.masks(docs).collect()}
    assert got["a"] & 16 == 0 and got["b"] & 16 and got[None] & 16
