"""Collocations, ranked lexical search and license scans next to brute-force versions."""

import collections
import math
import random
import re

import pytest

from pneuma.llm import collocations, lexical_search, license_scan

from .conftest import ODD

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# collocations

def brute_collocations(rows, threshold, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOW)):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i:i + k])] += 1
    cands = {p: a for p, a in f.items() if a >= threshold and len(p[1]) > 1}
    out = collections.defaultdict(list)
    for (lang, p), a in cands.items():
        if any(x[0] == lang and len(x[1]) > len(p) and b >= a and any(x[1][i:i + len(p)] == p for i in range(len(x[1]) - len(p) + 1))
               for x, b in cands.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:j]] * f[lang, p[j:]]), j, f[lang, p[:j]], f[lang, p[j:]])
                                    for j in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
                  for lang, xs in out.items() for i, (s, a, p, left, right) in enumerate(sorted(xs)[:top]))


def _mined(docs, threshold, **kw):
    return sorted(tuple(r) for r in collocations.ranked(collocations.collocations(docs, threshold, **kw)).collect())


@pytest.mark.parametrize("shards", [1, 3, 4])
def test_collocations_against_brute_force(spark, shards):
    rng = random.Random(shards)
    vocabulary = ["a", "B", "c", "é", "d,", "e.", "日本", "f\n", "G;", "h\tq"]
    rows = [(rng.choice(["en", "fr", None]), " ".join(rng.choices(vocabulary, range(10, 0, -1), k=rng.randint(0, 60)))) for _ in range(120)]
    rows += [("en", "new york city hall is big")] * 15 + [("fr", None), ("fr", ""), ("en", " ,.; ")]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert _mined(docs, 12, shards=shards) == brute_collocations(rows, 12)


def test_late_phrases_get_their_whole_cycle(spark):
    # a phrase that becomes frequent in the last shard is counted in the shards before, too
    rows = [("en", "x y z")] * 4 + [("en", "q")] * 20 + [("en", "x y z")] * 9 + [("en", "y z x y")] * 3
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    assert _mined(docs, 10) == brute_collocations(rows, 10)


def test_few_counters_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST_COUNTERS", 8)
    rng = random.Random(5)
    rows = [("en", " ".join(rng.choices("abcdefgh", k=30))) for _ in range(60)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert _mined(docs, 15, counters=8) == brute_collocations(rows, 15)


def test_collocation_chunks_keep_phrases_whole():
    import numpy as np
    data = " ".join(f"w{i % 7} x{i % 3}" for i in range(500)).encode()
    for size in (1, 10, 100):
        assert b"".join(collocations.cut(data, size)) == data
        sums: collections.Counter = collections.Counter()
        total, before = 0, []
        for part in collocations.cut(data, size):
            words = collocations.tokens(b" ".join([*before, part]))
            if len(words):
                chunk = collocations.Chunk(words, len(before), "en", 64, np.full(8, 255, np.uint8))
                total += chunk.word_counts().sum()
                for k, start, _ in chunk.phrases(5):
                    if len(start):
                        phrases, n, _ = chunk.named(k, start)
                        sums.update(dict(zip(phrases.to_pylist(), n.tolist())))
            before = words.to_pylist()[-4:]
        w = data.split()
        assert sums == collections.Counter(b" ".join(w[i:i + k]) for k in range(2, 6) for i in range(len(w) - k + 1)) and total == len(w)


@pytest.mark.parametrize("threshold", [3, 300, 70_000])
def test_counters_stop_at_the_threshold(spark, threshold):
    import numpy as np
    kind = collocations._kind(threshold)
    one = np.array([threshold, 1, 0, threshold - 1] * 4, kind)
    rows = spark.createDataFrame([(0, p, bytearray(one.tobytes())) for p in range(2)], "slice int, part int, counts binary")
    r = collocations._sum(rows, ["slice"], threshold).first()
    assert np.frombuffer(r.counts, kind).tolist() == [threshold, 2, 0, threshold] * 4
    assert np.unpackbits(np.frombuffer(r.reached, np.uint8), bitorder="little").tolist() == [1, int(2 >= threshold), 0, 1] * 4


def test_collocations_of_odd_rows(spark, make_docs):
    docs = make_docs(ODD * 3, extra=True)
    rows = [("en", t) for _, t in ODD * 3]
    assert _mined(docs, 3) == brute_collocations(rows, 3)
    assert _mined(docs.limit(0), 3) == []


def test_score_beyond_64_bits(spark):
    big = 4_000_000_000_000
    got = spark.sql(f"SELECT (cast(1000 * {big} as decimal(19,0)) * cast({big * 100} as decimal(19,0))) div "
                    f"(cast({big} as decimal(19,0)) * cast({big} as decimal(19,0))) AS s").first().s
    assert got == 1000 * big * big * 100 // (big * big)


# ranked search

def brute_search(docs, queries, top=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    bags = [(d, collections.Counter(words(t)), len(words(t))) for d, t in docs]
    n, total = sum(1 for _, _, x in bags if x), sum(x for _, _, x in bags)
    df = collections.Counter(w for _, b, _ in bags for w in b)
    out = []
    for key, text in queries:
        scored = []
        for d, b, x in bags:
            m = 10 + 90 * x * n // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * b[w] // (1000 * b[w] + 8 * m))
                    for w in set(words(text)) if w in b)
            if s > 0:
                scored.append((-s, math.inf if d is None else d))
        out += [(key, i + 1, None if d == math.inf else d, -s) for i, (s, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def _found(docs, queries, spark, top=10, **kw):
    q = spark.createDataFrame(queries, "item_id long, text string")
    index = lexical_search.build_index(docs, **kw)
    return sorted((tuple(r) for r in lexical_search.search(index, q, top=top).select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("segment", [4, 50, 10_000])
def test_search_against_brute_force(spark, make_docs, segment):
    rng = random.Random(segment)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "日本", "A1", "x-y", "same"]
    text = lambda n: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=n))
    docs = [(i, text(rng.randint(0, 80))) for i in range(300)]
    docs += [(400 + i, docs[7][1]) for i in range(25)]  # a group of copies: equal scores
    rng.shuffle(docs)
    queries = [(i, text(rng.randint(0, 12))) for i in range(12)] + [(50, docs[0][1]), (51, None), (52, "absent"), (53, " w1 W1 w1 ")]
    assert _found(make_docs(docs).repartition(3), queries, spark, segment_docs=segment) == brute_search(docs, queries)


def test_search_odd_rows_and_blocks(spark, make_docs, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_QUERIES", 2)
    queries = [(1, "one two"), (1, "one"), (2, "a p 日本語"), (3, ""), (None, "HERE, there")]
    assert _found(make_docs(ODD, extra=True), queries, spark, top=3) == brute_search(ODD, queries, 3)
    assert _found(make_docs(ODD).limit(0), queries, spark) == []
    assert _found(make_docs(ODD), [(1, None)], spark) == []


def test_interval_bounds(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    docs, tfs = [np.sort(rng.choice(200, n, replace=False)) for n in (1, 7, 64, 200)], [rng.integers(1, 9, n) for n in (1, 7, 64, 200)]
    seg = lexical_search.Lists(list("abcd"), docs, tfs, list(range(200)), rng.integers(1, 500, 200), 200, 40_000)
    for t in range(4):
        for a in range(seg.begin[t], seg.begin[t + 1]):
            for b in range(a, seg.begin[t + 1] + 1, 3):
                at = seg.best(np.array([a]), np.array([b]))[0]
                assert (at == -1) if a == b else seg.impact[at] == seg.impact[a:b].max() and a <= at < b


# license scans

def brute_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    found = [(i, label) for p, label in license_scan.BASE for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
    labels, best = set(), 0.0
    for label, t in license_scan.TEMPLATES:
        t = re.findall("[a-z0-9]+", t.lower())
        diag = collections.defaultdict(list)
        for i in range(len(words) - 2):
            for j in range(len(t) - 2):
                if words[i:i + 3] == t[j:j + 3]:
                    diag[i - j].append(i)
        for d, hits in diag.items():
            near = {x: diag[x] for x in range(d - 3, d + 4) if x in diag}
            if max(near, key=lambda x: (len(near[x]), -x)) != d or sum(map(len, near.values())) < math.ceil(len(t) / 4) - 2:
                continue
            span = words[min(map(min, near.values())):max(map(max, near.values())) + 3]
            n = max(len(span), len(t))
            if (n - distance(span, t)) / n >= license_scan.MIN_SIMILARITY:
                labels.add(label)
                best = max(best, (n - distance(span, t)) / n)
    return (len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None),
            ",".join(sorted({x for _, x in found})), ",".join(sorted({x for _, x in found} | labels)), best)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def _texts():
    rng = random.Random(3)
    noise = lambda n: " ".join(rng.choices(["the", "of", "license", "under", "word", "é", "mit", "cc", "by", "gnu"], k=n))
    texts = [noise(rng.randint(0, 50)) for _ in range(20)]
    for label, t in license_scan.TEMPLATES:
        texts += [t, f"{noise(30)} {t.upper()}. {noise(9)}", t[:len(t) // 2], f"{t}\n{t}\n{noise(3)} {t}"]
        w = t.split()
        for share in (0.05, 0.15, 0.4):
            texts.append(" ".join(x if rng.random() > share else rng.choice(["", "other", x + " more"]) for x in w))
    return texts + ["MIT License MIT License, mit-license " * 40, "CC-BY 4.0 cc by", "İ license K apache license apache license"]


def test_licenses_against_brute_force(spark, make_docs):
    docs = list(enumerate(_texts())) + ODD
    rows = license_scan.license_report(make_docs(docs, extra=True)).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()
    key = lambda r: (str(r[0]), *map(str, r))
    assert sorted((tuple(r) for r in rows), key=key) == sorted(((d, *brute_license(t)) for d, t in docs), key=key)


def test_whole_and_slightly_changed_notices_are_labelled(spark, make_docs):
    docs = [(i, f"words before {t} words after") for i, (_, t) in enumerate(license_scan.TEMPLATES)]
    got = {r.doc_id: r for r in license_scan.license_report(make_docs(docs)).collect()}
    assert all(license_scan.TEMPLATES[i][0] in r.labels.split(",") and r.score == 1.0 for i, r in got.items())


def test_license_tables_of_the_user(spark, make_docs):
    own = license_scan.template_table(spark, [("house", "You may read this but never sell it")])
    got = license_scan.license_report(make_docs(["You may read this, but never sell it!", "MIT License"]), own).orderBy("doc_id").collect()
    assert [r.labels for r in got] == ["house", "mit"]
    with pytest.raises(ValueError):
        license_scan.license_report(make_docs(["x"]), license_scan.template_table(spark, [("short", "two words")]))
    assert license_scan.license_report(make_docs([]).limit(0)).count() == 0


def test_license_scan_has_no_python(spark, make_docs):
    plan = license_scan.license_report(make_docs(["MIT License"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
