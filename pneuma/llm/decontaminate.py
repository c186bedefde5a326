"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items become words (lower case, letters and digits only). An item is cut into
units of at least ``unit_words`` words, and once more into windows of ``unit_words`` words with a start every half window, so that
an excerpt of one and a half windows holds a whole one wherever it is taken; a unit of m words may differ from a passage by
k = floor(error_rate * m) word edits. It is split into k + 1 pieces, one of which must
stand in the passage unchanged, so an Aho-Corasick scan for all pieces finds every
possible place, and Myers' bit-parallel distance, on words, decides there. A unit found within
its budget marks the document.

Items with fewer than ``exact_words`` words are found only word by word, without an edit; items without a word never.
Null texts, null items and null ids: a null text has no words; an item with a null id
is matched and reported with a null item_id. Repeated rows give the same result each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, checkpoint, ship

ERROR_RATE = 0.15
UNIT_WORDS = 25
EXACT_WORDS = 8
#: Test items that are matched in one pass over the documents, in characters; more items take more passes. The automaton of a block
#: takes about 60 bytes a character in every worker.
BLOCK_CHARS = 1_000_000
_OTHER = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\W_]+")


def normal(text: str | None) -> str:
    """The words with a single space before, between and after them."""
    return f" {_OTHER.sub(' ', (text or '').lower()).strip()} "


def units(words: list[str], unit_words: int = UNIT_WORDS) -> list[list[str]]:
    """An item's words cut evenly into units of ``unit_words`` words at least (one unit if there are fewer), then the windows."""
    n = max(1, len(words) // unit_words)
    edges = [len(words) * i // n for i in range(n + 1)]
    even = [(a, b) for a, b in zip(edges, edges[1:]) if a < b]
    last = len(words) - unit_words
    starts = sorted({*range(0, last + 1, max(1, unit_words // 2)), last}) if last > 0 else []
    return [words[a:b] for a, b in dict.fromkeys([*even, *((a, a + unit_words) for a in starts)])]


def myers(pattern: list[str], text: list[str]) -> list[int]:
    """For each end in ``text`` the least word edit distance of ``pattern`` to a stretch that ends there (Myers 1999)."""
    m = len(pattern)
    eq: dict[str, int] = {}
    for i, w in enumerate(pattern):
        eq[w] = eq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, score, out = full, 0, m, []
    for w in text:
        e = eq.get(w, 0)
        x = e | down
        h = (((e & up) + up) ^ up) | e
        plus, minus = down | ~(h | up) & full, up & h
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(x | plus) & full, plus & x
        out.append(score)
    return out


class Matcher:
    """Pieces of a block of units in one automaton; built once per worker and block."""

    _built: dict[str, "Matcher"] = {}

    def __init__(self, items: list[tuple], error_rate: float, unit_words: int, exact_words: int):
        import ahocorasick
        self.units: list[tuple] = []  # (item number, words, budget)
        pieces: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text) in enumerate(items):
            words = normal(text).split()
            for unit in units(words, unit_words):
                k = int(error_rate * len(unit)) if len(words) >= exact_words else 0
                u = len(self.units)
                self.units.append((number, unit, k))
                edges = [len(unit) * i // (k + 1) for i in range(k + 2)]
                for a, b in zip(edges, edges[1:]):
                    pieces.setdefault(f" {' '.join(unit[a:b])} ", []).append((u, a))
        self.ids = [i for i, _ in items]
        self.auto = ahocorasick.Automaton()
        for p, at in pieces.items():
            self.auto.add_word(p, (len(p), at))
        if pieces:
            self.auto.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item number, distance, first word, end word) of every unit found, best of each place."""
        if not self.units or not text:
            return []
        t = normal(text)
        hits = list(self.auto.iter(t))
        if not hits:
            return []
        import numpy as np
        spaces = np.array([m.start() for m in re.finditer(" ", t)])
        words = t.split()
        starts: dict[int, list[int]] = {}
        for end, (size, at) in hits:
            w = int(np.searchsorted(spaces, end - size + 1))
            for u, offset in at:
                starts.setdefault(u, []).append(w - offset)
        out = []
        for u, s in starts.items():
            number, unit, k = self.units[u]
            s.sort()
            i = 0
            while i < len(s):
                j = i
                while j + 1 < len(s) and s[j + 1] - s[j] <= 2 * k:
                    j += 1
                lo, hi = max(0, s[i] - k), min(len(words), s[j] + len(unit) + k)
                score = myers(unit, words[lo:hi])
                best = min(range(len(score)), key=score.__getitem__, default=None)
                if best is not None and score[best] <= k:
                    back = myers(unit[::-1], words[lo:lo + best + 1][::-1])
                    length = min(range(len(back)), key=lambda x: (back[x], abs(x + 1 - len(unit)))) + 1
                    out.append((number, score[best], lo + best + 1 - length, lo + best + 1))
                i = j + 1
        return out


def places(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of units of one item that overlap in the text, the one of least distance (the longest of those, then the first)."""
    out: list[tuple[int, int, int, int]] = []
    end = {}
    for number, distance, a, b in sorted(found, key=lambda x: (x[0], x[2], x[3])):
        if number in end and a < end[number]:
            if (distance, a - b) < (out[-1][1], out[-1][2] - out[-1][3]):
                out[-1] = (number, distance, a, b)
            end[number] = max(end[number], b)
        else:
            out.append((number, distance, a, b))
            end[number] = b
    return out


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where each of a text's words stands in it, also where lower-casing makes characters longer."""
    low = text.lower()
    spans = [x.span() for x in _WORD.finditer(low)]
    if len(low) == len(text):
        return spans
    import numpy as np
    ends = np.cumsum([len(c.lower()) for c in text])
    at = lambda i: int(np.searchsorted(ends, i, side="right"))
    return [(at(a), at(b - 1) + 1) for a, b in spans]


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple]]:
    block, held = [], 0
    for r in benchmark.select("item_id", "text").dropDuplicates().toLocalIterator():
        block.append((r[0], r[1] or ""))
        held += len(r[1] or "")
        if held >= limit:
            yield block
            block, held = [], 0
    if block:
        yield block


def _matcher(sent, options: tuple):
    key = f"{sent.value[0]}"
    if key not in Matcher._built:
        Matcher._built.clear()
        Matcher._built[key] = Matcher(sent.value[1], *options)
    return Matcher._built[key]


def _send(spark, block: list[tuple]):
    import uuid
    return spark.sparkContext.broadcast((uuid.uuid4().hex, block))


def matches(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, unit_words: int = UNIT_WORDS,
            exact_words: int = EXACT_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, start, end, n_places) for each document and item with a unit found.

    distance is the least of the units', start and end its place in the text in code points; units that overlap are one place.
    The test items are a query set that is sent out in blocks of bounded size, each in one pass.
    """
    ship(docs.sparkSession)
    spark, options = docs.sparkSession, (error_rate, unit_words, exact_words)
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    kind = dict(benchmark.dtypes)["item_id"]

    def scan(sent) -> DataFrame:
        def run(it: Iterator) -> Iterator:
            import pyarrow as pa
            m = _matcher(sent, options)
            for batch in batches_by_bytes(it, "text", 4 << 20):
                rows = []
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found = places(m.find(t))
                    if found:
                        spans = word_spans(t)
                        rows.extend((d, number, distance, spans[a][0], spans[b - 1][1]) for number, distance, a, b in found)
                if rows:
                    cols = list(zip(*rows))
                    ids = pa.array([m.ids[i] for i in cols[1]])
                    yield pa.record_batch([pa.array(cols[0], pa.int64()), ids.cast(pa.int64()) if kind == "bigint" else ids,
                                           *(pa.array(c, pa.int64()) for c in cols[2:])],
                                          names=["doc_id", "item_id", "distance", "start", "end"])
        return source.mapInArrow(run, f"doc_id long, item_id {kind}, distance long, start long, end long")

    found, sent = None, None
    for block in _blocks(benchmark, block_chars):
        if sent is not None:  # more than one block: the earlier one's result is kept, its items are let go
            found = checkpoint(found)
            sent.unpersist()
        sent = _send(spark, block)
        part = scan(sent)
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], f"doc_id long, item_id {kind}, distance long, start long, end long")
    return (found.groupBy("doc_id", "item_id")
            .agg(F.min(F.struct("distance", "start", "end")).alias("m"), F.count(F.lit(1)).alias("n_places"))
            .select("doc_id", "item_id", "m.distance", "m.start", "m.end", "n_places"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE,
                    unit_words: int = UNIT_WORDS, exact_words: int = EXACT_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no test item is found; a filter without a shuffle."""
    ship(docs.sparkSession)
    options = (error_rate, unit_words, exact_words)
    place = docs.columns.index("text")

    def keep(df: DataFrame, sent) -> DataFrame:
        def run(it: Iterator) -> Iterator:
            import pyarrow as pa
            m = _matcher(sent, options)
            for batch in batches_by_bytes(it, "text", 4 << 20):
                yield batch.filter(pa.array([not m.find(t) for t in batch.column(place).to_pylist()], pa.bool_()))
        return df.mapInArrow(run, docs.schema)

    out = docs
    for block in _blocks(benchmark, block_chars):
        out = keep(out, _send(docs.sparkSession, block))
    return out
