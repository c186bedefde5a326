import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pneuma.llm import components, simhash, suffix_dedup

from .conftest import ODD


def brute_suffix(rows):
    """What each row loses, by a set of all 50-byte strings of smaller documents."""
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        others = {x.encode()[i:i + 50] for e, x in rows if d is not None and e is not None and e < d and x
                  for i in range(len(x.encode()) - 49)}
        for i in range(len(b) - 49):
            if b[i:i + 50] in others:
                gone[i:i + 50] = b"\1" * 50
        spans = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((-1 if d is None else d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def suffix_rows(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                  for r in df.collect())


def corpus(seed):
    rng = random.Random(seed)
    word = ["ab", "cde", "fé", "日", "gh ij", "\n"]
    text = lambda n: " ".join(rng.choice(word) for _ in range(n))
    passage, line = text(40), text(16)
    rows = [(i, text(rng.randint(0, 60)) + (passage if rng.random() < .4 else "") + text(9)
             + (line if rng.random() < .6 else "") + text(rng.randint(0, 30))) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(10)] + [(5, rows[3][1]), (5, rows[3][1]), (None, passage)]
    rows += [(200, "aaaa " * 500), (201, "aaaa " * 300), (202, "A" * 49), (203, "A" * 50), (204, "A" * 51)]
    return rows


@pytest.mark.parametrize("options", [{}, {"sample": 1, "frequent": 3}, {"bucket_bytes": 500, "refine_bytes": 200}])
def test_suffix_dedup(spark, make_docs, options):
    rows = corpus(1)
    assert suffix_rows(suffix_dedup.dedup(make_docs(rows, extra=True).repartition(3), **options)) == brute_suffix(rows)


def test_suffix_long_documents_in_parts(spark, make_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    rows = corpus(2)
    texts = [t.encode() for _, t in rows if t]
    doc, start, count, anchor, content = suffix_dedup.stretches(texts)
    for i, t in enumerate(texts):
        here = sorted(zip(start[doc == i].tolist(), count[doc == i].tolist()))
        assert [s + k for s, n in here for k in range(n)] == list(range(max(0, len(t) - 49)))
    by_anchor = {}
    for i, s, n, a in zip(doc, start, count, anchor):  # equal strings share their anchor
        for k in range(n):
            assert by_anchor.setdefault(texts[i][s + k:s + k + 50], a) == a


def test_suffix_odd_rows(spark, make_docs):
    assert suffix_rows(suffix_dedup.dedup(make_docs(ODD, extra=True))) == brute_suffix(ODD)
    assert suffix_dedup.dedup(make_docs([])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=50, max_size=300).map(lambda b: bytes(x % 3 for x in b)))
def test_refine_names_equal_strings(data):
    bucket = suffix_dedup.refine(np.frombuffer(data, np.uint8), 50)
    names = {}
    for i in range(len(data) - 49):
        assert names.setdefault(data[i:i + 50], bucket[i]) == bucket[i]
    assert len(set(names.values())) == len(names)


def test_only_bytes_of_shared_strings_are_refined(monkeypatch):
    rng = np.random.default_rng(3)
    sizes, seen = [], suffix_dedup.refine
    monkeypatch.setattr(suffix_dedup, "refine", lambda data, size: sizes.append(len(data)) or seen(data, size))
    passage = rng.integers(97, 123, 80).astype(np.uint8).tobytes()
    texts = [rng.integers(97, 123, 400).astype(np.uint8).tobytes() for _ in range(30)]
    texts += [texts[0][:70] + passage + texts[1][:33], passage[:60] + texts[2][100:300], texts[3][:30] + passage + texts[3][:120]]

    def stretches(texts):
        doc = np.array([5 * i % 33 for i in range(len(texts))])
        count = np.array([len(t) - 49 for t in texts])
        return doc, doc + 100, np.full(len(texts), 7), count, np.frombuffer(b"".join(texts), dtype=np.uint8)

    doc, _, _, count, _ = x = stretches(texts)
    got = sorted(zip(*(v.tolist() for v in suffix_dedup.repeats(*x))))
    least = {}
    for d, t in zip(doc, texts):
        for i in range(len(t) - 49):
            least[t[i:i + 50]] = min(least.get(t[i:i + 50], 99), d)
    want = sorted((d, d + 100, 7 + i) for d, t in zip(doc, texts) for i in range(len(t) - 49) if least[t[i:i + 50]] < d)
    assert got == want and len(want) > 60
    assert len(sizes) == 1 and sizes[0] < sum(map(len, texts)) / 5
    assert not len(suffix_dedup.repeats(*stretches(texts[3:9]))[0]) and len(sizes) == 1


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    import re
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, bits):
    parent = list(range(len(prints)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(prints))]


def test_simhash_odd_rows(spark, make_docs):
    rows = ODD + [(20, "Ünï ONE two Three " * 30), (21, "a b"), (22, "a b c")]
    found = simhash.near_duplicates(make_docs(rows, extra=True), max_bits=2).collect()
    prints = [brute_print(t) for _, t in rows]
    group = brute_groups(prints, 2)
    least = {g: min((d for (d, _), h in zip(rows, group) if h == g and d is not None), default=None) for g in group}
    want = sorted((d or -1, p, least[g] or -1) for (d, _), p, g in zip(rows, prints, group))
    assert sorted((r.doc_id or -1, r.fp % 2 ** 64, r.component_id or -1) for r in found) == want
    assert simhash.near_duplicates(make_docs([])).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_links_are_complete(spark, bits):
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(40)] + [0, 2 ** 64 - 1]
    prints = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & 2 ** 64 - 1 for b in base for _ in range(6)})
    signed = [p - 2 ** 64 if p >= 2 ** 63 else p for p in prints]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bits).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & 2 ** 64 - 1).count("1") <= bits}
    assert got == want


def test_links_never_broadcast_probes(spark):
    """However small Spark takes the fingerprints to be: each is 66 probes."""
    plan = simhash.links(spark.range(100).selectExpr("id * 7 AS fp"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_keep_one(spark, make_docs):
    rows = [(i, f"words that differ {i % 7} " * 9) for i in range(30)] + [(3, "again"), (3, "again"), (None, "again")]
    docs = make_docs(rows, extra=True)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    group = brute_groups([brute_print(t) for _, t in rows], 2)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted(
        min((d for d in rows if d[0] is not None and group[rows.index(d)] == g)) for g in set(group))
    assert simhash.keep_one(make_docs([])).count() == 0


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)], [], [(5, 5)],
                                   [(random.Random(i).randrange(80), random.Random(-i).randrange(80)) for i in range(1, 70)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges if e[0] != e[1] for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(top(a), top(b))] = min(top(a), top(b))
    assert got == {x: top(x) for x in parent}


def test_keep_one_of_rows_that_repeat_id_and_text(spark):
    """Whatever the order of the rows, the same one of them stays."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en", s, i) for i, s in enumerate("abcdefg")] + [(2, "other words here", "en", "z", 1), (2, "other words here", "en", "z", 1)]
    kept = set()
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        got = sorted(tuple(r) for r in simhash.keep_one(docs).collect())
        assert [r[0] for r in got] == [1, 2]
        kept.add(tuple(got))
    assert len(kept) == 1
