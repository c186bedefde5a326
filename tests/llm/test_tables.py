import datetime as dt
import random

from pyspark.sql import functions as F
import pytest

from pneuma.llm import preference, url_lists

DAY = dt.date(2024, 1, 1)


def brute_verdict(url, day, entries):
    from urllib.parse import urlsplit
    if url is None or day is None or "://" not in url:
        return "none", None, None
    u = urlsplit(url)
    host = (u.hostname or "").rstrip(".")
    if not host:
        return "none", None, None
    segment = "/" + u.path[1:].split("/")[0] if u.path else ""
    labels = host.split(".")
    order = [("prefix", host + segment), ("host", host)] + [("domain", ".".join(labels[i:])) for i in range(len(labels) - 1)]
    for kind, pattern in order:
        before = [(e["day"], e["entry_id"], e["action"]) for e in entries
                  if (e["kind"], e["pattern"]) == (kind, pattern) and e["day"] is not None and e["day"] <= day]
        if before and max(before)[2] != "remove":
            return max(before)[2], kind, max(before)[1]
    return "none", None, None


def test_url_lists(spark):
    rng = random.Random(1)
    hosts = ["a.b.example.com", "b.example.com", "example.com", "x.org", "localhost"]
    patterns = [("host", h) for h in hosts] + [("domain", d) for d in ("example.com", "b.example.com", "x.org", "com")] + [
        ("prefix", h + "/en") for h in hosts] + [("prefix", "x.org"), ("prefix", "x.org/")]
    entries = [{"kind": k, "pattern": p, "day": DAY + dt.timedelta(rng.randrange(40)), "action": rng.choice(["block", "allow", "remove"]),
                "entry_id": i} for i in range(250) for k, p in [rng.choice(patterns)]]
    entries += [dict(entries[0])] * 3 + [{"kind": "host", "pattern": None, "day": DAY, "action": "block", "entry_id": 1},
                                         {"kind": "host", "pattern": "x.org", "day": None, "action": "block", "entry_id": 1}]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/1", "/de?x=1", "#f")] + [
        "HTTPS://user:pw@B.Example.COM:8080/en/2", "http://x.org./", None, "", "no url", "http:///en"]
    caps = [(i, u, None if i % 41 == 0 else DAY + dt.timedelta(rng.randrange(45)))
            for i, u in enumerate(u for u in urls for _ in range(12))] + [(5, urls[0], DAY)] * 2
    got = url_lists.evaluate(spark.createDataFrame(caps, "page_id long, url string, day date").selectExpr("*", "'h' AS held"),
                             spark.createDataFrame(entries, "kind string, pattern string, day date, action string, entry_id long"))
    key = lambda r: (r[0], str(r[1]), str(r[2]))
    have = sorted(((r.page_id, r.url, r.day, r.verdict, r.kind, r.entry_id) for r in got.collect()), key=key)
    assert have == sorted(((i, u, d, *brute_verdict(u, d, entries)) for i, u, d in caps), key=key)
    none = url_lists.evaluate(spark.createDataFrame(caps, "page_id long, url string, day date"),
                              spark.createDataFrame([], "kind string, pattern string, day date, action string, entry_id long"))
    assert {r.verdict for r in none.collect()} == {"none"} and none.count() == len(caps)


def brute_rows(chosen, rejected):
    """Rows of one pair from two lists of (role, text)."""
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    out = []
    for part, turns, base in (("prompt", chosen[:n], 0), ("chosen", chosen[n:], n), ("rejected", rejected[n:], n)):
        at = 0
        for i, (role, text) in enumerate(turns):
            shown = f"<|{role}|>\n{text}<|end|>\n"
            out.append((part, base + i, role, shown, at, at + len(shown), int(role == "assistant" and part != "prompt")))
            at += len(shown)
    return sorted(out)


@pytest.mark.parametrize("block", [2, 256])
def test_preference(spark, monkeypatch, block):
    monkeypatch.setattr(preference, "BLOCK_TURNS", block)
    rng = random.Random(2)
    pairs = {}
    for p in range(30):
        base = [(rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "", "😀 x"])) for _ in range(rng.randrange(9))]
        cut = rng.randrange(len(base) + 1)
        pairs[p] = (base, base[:cut] + [(rng.choice(["user", "assistant"]), "other") for _ in range(rng.randrange(4))])
    pairs[40] = ([("user", "q")] * 700, [("user", "q")] * 699 + [("assistant", "r")])

    def frame(side):
        rows = [(p, 3 * i, r, t) for p, x in pairs.items() for i, (r, t) in enumerate(x[side])]
        return preference.positions(spark.createDataFrame(rows, "pair_id long, turn long, role string, text string"))

    got = {}
    for r in preference.preference_rows(frame(0), frame(1)).collect():
        got.setdefault(r.pair_id, []).append((r.part, r.pos, r.role, r.rendered, r.start, r.end, r.mask))
    assert {p: sorted(x) for p, x in got.items()} == {p: brute_rows(*x) for p, x in pairs.items() if x[0] or x[1]}


def test_positions_of_odd_turns(spark):
    rows = [(1, None, "user", "z"), (1, 2, None, None), (1, 2, "assistant", "b"), (1, 2, "assistant", "b"), (None, 0, "user", "x"),
            (1, -5, "system", "s")]
    df = spark.createDataFrame(rows, "pair_id long, turn long, role string, text string")
    got = sorted((r.pos, r.role, r.text) for r in preference.positions(df.selectExpr("*", "9 AS _block", "1 AS pos")).collect())
    assert got == [(0, "user", "z"), (1, "system", "s"), (2, "assistant", "b"), (3, "assistant", "b"), (4, "unknown", "")]


def test_pairs_of_conversations(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (1, 2, "user", "more"), (2, 0, "user", "q2"), (2, 1, "assistant", "a2"),
            (4, 0, "user", "only")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = sorted((r.pair_id, r.part, r.rendered.split("\n")[1].removesuffix("<|end|>"), r.mask)
                 for r in preference.preference_rows(*preference.pairs_of(conv)).collect())
    assert out == [(1, "chosen", "a1", 1), (1, "chosen", "more", 0), (1, "prompt", "q", 0), (1, "rejected", "a2", 1),
                   (1, "rejected", "more", 0), (2, "chosen", "a2", 1), (2, "prompt", "q2", 0), (4, "prompt", "only", 0)]
    assert preference.preference_rows(*preference.pairs_of(conv.limit(0))).count() == 0


def test_every_turn_is_in_the_chosen_conversation(spark):
    """Repeated turns, null text and roles, a very long text, many turns after the last reply."""
    rows = [(1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, None, None), (1, 2, "assistant", "x" * 200_000), (1, 2, "assistant", "x" * 200_000),
            (2, 0, "assistant", "a"), *[(2, i, "user", f"t{i}") for i in range(1, 700)], (None, 0, "user", "no pair"),
            (3, 0, "assistant", "a"), (4, None, "assistant", None)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"pos": F.lit(1), "part": F.lit("x")})
    out = preference.preference_rows(*preference.pairs_of(conv)).collect()
    for c in (1, 2, 3, 4):
        own = sorted((r for r in out if r.pair_id == c and r.part != "rejected"), key=lambda r: r.pos)
        assert [r.pos for r in own] == list(range(sum(x[0] == c for x in rows)))
        for part in ("prompt", "chosen", "rejected"):
            at = 0
            for r in sorted((r for r in out if (r.pair_id, r.part) == (c, part)), key=lambda r: r.pos):
                assert (r.start, r.end) == (at, at + len(r.rendered))
                at = r.end
    assert [r.part for r in out if r.pair_id == 2] == ["prompt"] * 700  # the next conversation's reply is the same
    assert sum(r.part == "rejected" for r in out if r.pair_id == 1) == 1 and sum(r.part == "rejected" for r in out if r.pair_id == 4) == 0
