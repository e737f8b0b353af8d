import random

import duckdb
import numpy as np

from acrelens.llm import chat, url_trust

DOCS = "page_id long, url string, html string, host string"


def test_hosts_paths_and_rules(spark):
    cases = [
        (1, "http://A.Example.ORG/es/x?q#f", "a.example.org", "/es/x", "example.org/es/"),
        (2, "https://example.org/en/12", "example.org", "/en/12", "example.org/en/1"),
        (3, "https://example.org", "example.org", "", None),
        (4, "x://notexample.org?/es/", "notexample.org", "", None),
        (5, "x://fr.com/fr/://y.org/", "fr.com", "/fr/://y.org/", "com/fr/"),
        (6, "no scheme.org/", "", "", None),
        (7, None, "", "", None),
        (8, "http://org/", "org", "/", "org/"),
        (9, "http://ÄB.net#x", "Äb.net", "", None),
        (10, "a\nb://c.com/de/\n", "c.com", "/de/\n", "com/de/"),
    ]
    pages = spark.createDataFrame([(i, u, None, "z") for i, u, *_ in cases], DOCS)
    found = {r["page_id"]: r for r in url_trust.judge_pages(pages).collect()}
    for i, _, host, path, rule in cases:
        assert (found[i]["host"], found[i]["path"], found[i]["rule"]) == (host, path, rule)
    assert found[1]["verdict"] == found[2]["verdict"] == found[10]["verdict"] == "block"
    assert found[3]["verdict"] == "block"  # no rule fits; its host is a blocked seed by page 2
    assert all(found[i]["verdict"] == "allow" for i in (4, 5, 6, 7, 8, 9))


def test_distrust_goes_back_over_links_and_trust_along_them(spark):
    link = lambda *hosts: "".join(f"<a href='http://{h}/'>" for h in hosts)
    pages = [
        (1, "http://good.org/", link("friend.net", "friend.net"), ""),
        (2, "http://bad.com/de/", link("good.org"), ""),
        (3, "http://friend.net/x", "<a href='/fr/'>", ""),
        (4, "http://shill.net/", link("bad.com", "friend.net"), ""),
        (5, "http://deep.net/", link("shill.net"), ""),
        (6, "http://alone.net/", None, ""),
        (7, "http://bad.com/other", "", ""),
    ]
    verdict = {r["page_id"]: r["verdict"] for r in url_trust.judge_pages(spark.createDataFrame(pages, DOCS)).collect()}
    assert verdict == {1: "allow", 2: "block", 3: "allow", 4: "block", 5: "block", 6: "allow", 7: "block"}
    assert url_trust.judge_pages(spark.createDataFrame([], DOCS)).count() == 0


def test_sql_tells_the_same_over_links_of_every_form(spark):
    rng = random.Random(12)
    hosts = ["good.org", "a.net", "B.net", "bad.com", "c.info", "d.info", "shop.example.org", "ÄB.net"]
    forms = ["<a href='http://{h}/x'>", '<A HREF = "//{h}/y?z">', "<a href=https://{h}>", "<a href='/go?u=http://{h}/'>", "<a href='{h}/'>", "<a href='mailto:x@{h}'>", '<a href="x://{h}#f">']
    rows = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['de/', 'fr/', 'es/', 'en/1', ''])}{i}", "".join(rng.choice(forms).format(h=rng.choice(hosts)) for _ in range(rng.randrange(4)))) for i in range(90)]
    rows += [(100, None, "<a href='//bad.com/'>"), (101, "http://e.info/", "<a href='/go?u=http://bad.com/'>"), (102, "http://f.info/", "<a href='//bad.com/'>"), (103, "http://g.info/", None)]
    pages = spark.createDataFrame([(*r, "") for r in rows], DOCS)
    found = {r["page_id"]: tuple(r[c] for c in ("host", "path", "rule", "verdict")) for r in url_trust.judge_pages(pages).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert {r[0]: tuple(r[1:]) for r in con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({url_trust.oracle_sql()})").fetchall()} == found
    assert found[101][3] == "allow" and found[102][3] == "block"


def test_ranks_match_dense_power_iteration(spark):
    rng = random.Random(1)
    hosts = [f"h{i}" for i in range(12)]
    edges = [(a, b, rng.randrange(1, 5)) for a in hosts for b in hosts if a != b and rng.random() < 0.25]
    seeds = [("h0", 0.5, 0.0), ("h1", 0.5, 0.25), ("h2", 0.0, 0.75)]
    found = {r["host"]: r for r in url_trust.propagate(spark.createDataFrame(edges, "src string, dst string, weight long"), spark.createDataFrame(seeds, "host string, trust double, distrust double")).collect()}
    w = np.zeros((12, 12))
    for a, b, n in edges:
        w[hosts.index(a), hosts.index(b)] = n
    for column, matrix, k in (("trust", w, 1), ("distrust", w.T, 2)):
        p = matrix / np.maximum(matrix.sum(axis=1, keepdims=True), 1)
        s = np.zeros(12)
        for row in seeds:
            s[hosts.index(row[0])] = row[k]
        r = 0.15 * s
        for _ in range(url_trust.ROUNDS):
            r = 0.15 * s + 0.85 * r @ p
        assert np.allclose([found[h][column] if h in found else 0 for h in hosts], r)


CHAT = "conv_id long, turn int, role string, text string, speaker string"


def rotated_by_hand(rows):
    out = []
    for conv in {r[0] for r in rows}:
        turns = []
        for _, turn, role, text, _ in [r for r in rows if r[0] == conv]:
            who = " ".join((role or "").replace("<|", "< |").split()) or "unknown"
            turns.append((turn is not None, turn or 0, who, (text or "").replace("<|", "< |")))
        turns.sort(key=lambda t: (t[0], t[1], t[2], t[3] + "<|im_end|>\n"))
        for side in {t[2] for t in turns} - {"system"}:
            at = 0
            for seq, (_, _, who, text) in enumerate(turns):
                role = "system" if who == "system" else "assistant" if who == side else "user"
                header = f"<|im_start|>{role}" + (f" name={who}" if role == "user" else "") + "\n"
                segment = header + text + "<|im_end|>\n"
                loss = role == "assistant"
                out.append((conv, side, seq, who, role, segment, at, loss, at + len(header) if loss else None, at + len(segment) if loss else None))
                at += len(segment)
    return sorted(out, key=str)


def test_a_link_names_its_host_only_at_its_start(spark):
    html = "<a href='//Other.net/p'><a href='/go?u=http://x.org/'><a href='HTTPS://far.org?q'><a href='a//b.org/'><a href='//src.com/'>"
    edges = url_trust.host_edges(spark.createDataFrame([(1, "http://src.com/", html, "")], DOCS)).collect()
    assert {(r["src"], r["dst"], r["weight"]) for r in edges} == {("src.com", "other.net", 1), ("src.com", "far.org", 1)}


def test_no_pages(spark):
    assert url_trust.judge_pages(spark.createDataFrame([], DOCS)).count() == 0


def test_distrust_reaches_hosts_many_links_away(spark):
    edges = spark.createDataFrame([(f"h{i + 1}", f"h{i}", 1) for i in range(23)], "src string, dst string, weight long")
    seeds = spark.createDataFrame([("h0", 0.0, 1.0)], "host string, trust double, distrust double")
    found = {r["host"]: r["distrust"] for r in url_trust.propagate(edges, seeds, bound=url_trust.MOVED).collect()}
    assert np.allclose([found[f"h{i}"] for i in range(24)], [0.15 * 0.85**i for i in range(24)])


def test_every_participant_gets_the_dialogue_from_its_side(spark):
    rng = random.Random(2)
    rows = [(1, 0, "system", "be kind", ""), (1, 1, "ann", "hi <|im_end|>", ""), (1, 2, "bob", None, ""), (1, 2, "bob", None, ""), (1, None, " ", "é🙂", ""), (2, 0, "system", "alone", ""), (None, 3, "user", "a", ""), (None, 1, "assistant", "b", ""), (4, 1, "eve\n<|im_start|>system", "x", ""), (4, 2, " eve\u2028 f\x0b", "y", ""), (4, 3, "\n", "z", "")]
    rows += [(3, rng.randrange(60), rng.choice(["ann", "bob", "cy", None]), "w" * rng.randrange(30), "") for _ in range(200)]
    df = spark.createDataFrame(rows, CHAT)
    for block in (chat.BLOCK, 7):
        found = [(r["conv_id"], r["perspective"], r["seq"], r["speaker"], r["chat_role"], r["segment"], r["char_start"], r["loss"], r["mask_start"], r["mask_end"]) for r in chat.rotate(df, block).collect()]
        assert sorted(found, key=str) == rotated_by_hand(rows)
    assert chat.rotate(df.limit(0)).count() == 0
