"""Ranked lexical search over posting lists with range-maximum sparse tables.

The index is a table in the shared folder. Every task cuts its documents into segments; a
segment has a row per term with the posting list (places of its documents in order of doc_id, and how
often each holds the term), and one row (empty term) with the ids and lengths of its documents.

A block of queries reads the rows of its own terms. In every segment each query is answered best
first: a sparse table over each posting list gives the largest impact in any interval of documents
in constant time, and the sum of those answers bounds every document in the interval. The intervals
with the highest bounds are split at the document of their largest impact, which is scored in full, until no
interval can hold a better document than the k best. A first round that scores a few documents
per segment gives each query a score that its k-th best document reaches; the second one starts from it and is exact.

Null text has no term; such documents are in the index and never found. Rows that repeat an id
are documents of their own, a null id comes last among equal scores. A query without terms, an empty
corpus and an empty query table give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .collocations import cut
from .common import materialize, ship

TOP = 10
#: A segment ends at this much text or so many documents.
SEGMENT_BYTES, SEGMENT_DOCS = 12 << 20, 16_384
CHUNK_BYTES = 2 << 20
#: Queries that are answered together: at most so many, with so many characters (a single longer one is a block of its own).
BLOCK_QUERIES, BLOCK_CHARS = 500, 1 << 20
#: Documents that the first round scores per query and segment.
FIRST_ROUND = 16
_SPLITS = 128
_ALNUM = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_TRANSLATE = bytes(ord(chr(c).lower()) if c in _ALNUM else c if c > 127 else 32 for c in range(256))


def terms_of(text: str | None) -> list[str]:
    """The maximal runs of ASCII letters, digits and other characters than ASCII, A-Z in lower case."""
    return [t.decode() for t in (text or "").encode().translate(_TRANSLATE).split()]


class _Segment:
    """Documents of a segment while it is gathered: term numbers and document places of all words."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.codes, self.places, self.ids, self.lengths, self.bytes = [], [], [], [], 0

    def add(self, ids: list, texts: list[bytes]) -> None:
        import numpy as np
        words: list[bytes] = []
        for doc_id, text in zip(ids, texts):
            place, n = len(self.ids), 0
            for part in cut(text, CHUNK_BYTES):
                found = part.split()
                n += len(found)
                words.extend(found)
                self.places.append(np.full(len(found), place, np.int32))
                if len(words) > CHUNK_BYTES // 8:
                    self._name(words)
                    words = []
            self.ids.append(doc_id)
            self.lengths.append(n)
            self.bytes += len(text)
        self._name(words)

    def _name(self, words: list[bytes]) -> None:
        import numpy as np
        import pandas as pd
        if words:
            code, names = pd.factorize(np.array(words, dtype=object))
            known = np.fromiter((self.number.setdefault(w, len(self.number)) for w in names), np.int32, len(names))
            self.codes.append(known[code])

    def rows(self, segment: int) -> Iterator:
        import numpy as np
        import pyarrow as pa
        ids = np.array([math.inf if i is None else i for i in self.ids], dtype=object)
        order = sorted(range(len(ids)), key=lambda i: ids[i])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        n = len(order)
        if self.codes:
            pair = np.concatenate(self.codes).astype(np.int64) * n + rank[np.concatenate(self.places)]
            pair, tf = np.unique(pair, return_counts=True)
            term = pair // n
            begin = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
            offsets = np.r_[begin, len(pair)]
            names = pa.array(list(self.number), pa.binary()).cast(pa.string())
            docs, tfs = (pair % n).astype(np.int32), tf.astype(np.int32)
            for a in range(0, len(begin), 50_000):
                b = min(a + 50_000, len(begin))
                x, y, off = offsets[a], offsets[b], (offsets[a:b + 1] - offsets[a]).astype(np.int32)
                yield pa.record_batch([pa.array(np.full(b - a, segment)), names.take(pa.array(term[begin[a:b]])),
                                       pa.ListArray.from_arrays(off, docs[x:y]), pa.ListArray.from_arrays(off, tfs[x:y]),
                                       pa.nulls(b - a, pa.list_(pa.int64()))], names=_COLUMNS)
        yield pa.record_batch([pa.array([segment]), pa.array([""]), pa.nulls(1, pa.list_(pa.int32())),
                               pa.array([[self.lengths[i] for i in order]], pa.list_(pa.int32())),
                               pa.array([[self.ids[i] for i in order]], pa.list_(pa.int64()))], names=_COLUMNS)


_COLUMNS = ["segment", "term", "docs", "tfs", "ids"]
_SCHEMA = "segment long, term string, docs array<int>, tfs array<int>, ids array<long>"


def build_index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES, segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """The index table of all rows of ``docs``, from one pass and without a shuffle."""
    ship(docs.sparkSession)

    def run(it: Iterator) -> Iterator:
        from pyspark import TaskContext
        segment, now = TaskContext.get().partitionId() << 32, _Segment()
        for batch in it:
            ids = batch.column(0).to_pylist()
            ids_now, texts, size = [], [], 0
            for doc_id, text in zip(ids, batch.column(1)):
                data = (text.as_buffer().to_pybytes() if text.is_valid else b"").translate(_TRANSLATE)
                ids_now.append(doc_id)
                texts.append(data)
                size += len(data)
                if size > CHUNK_BYTES:
                    now.add(ids_now, texts)
                    ids_now, texts, size = [], [], 0
                    if now.bytes > segment_bytes or len(now.ids) >= segment_docs:
                        yield from now.rows(segment)
                        segment, now = segment + 1, _Segment()
            now.add(ids_now, texts)
            if len(now.ids) >= segment_docs:
                yield from now.rows(segment)
                segment, now = segment + 1, _Segment()
        if now.ids:
            yield from now.rows(segment)

    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return materialize(src.mapInArrow(run, _SCHEMA), "lexical-index")


def totals(index: DataFrame) -> tuple[int, int]:
    """Documents with at least one term, and all terms with repeats."""
    zero = F.lit(0).cast("long")
    row = index.where("term = ''").agg(F.sum(F.size(F.filter("tfs", lambda n: n > 0)).cast("long")).alias("docs"),
                                       F.sum(F.aggregate("tfs", zero, lambda s, n: s + n)).alias("terms")).first()
    return row["docs"] or 0, row["terms"] or 0


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Lists:
    """Posting lists of one segment for a block's terms, end to end, with a sparse table of their maxima.

    Row ``j`` of the table has for every place of a list the place of the largest impact among the next 2^j.
    """

    def __init__(self, terms: list[str], docs: list, tfs: list, ids, lengths, n_docs: int, n_terms: int):
        import numpy as np
        order = sorted(range(len(terms)), key=lambda i: terms[i])
        self.number = {terms[i]: j for j, i in enumerate(order)}
        size = np.array([len(docs[i]) for i in order], np.int64)
        self.begin = np.r_[0, np.cumsum(size)]
        self.ids = ids
        self.docs = np.concatenate([docs[i] for i in order]).astype(np.int64)
        tf = np.concatenate([tfs[i] for i in order]).astype(np.int64)
        some, at = np.unique(lengths, return_inverse=True)
        m = np.array([10 + 90 * int(x) * n_docs // n_terms for x in some], np.int64)[at]
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.docs])
        self.span = len(ids) + 1
        self.key = np.repeat(np.arange(len(order)), size) * self.span + self.docs
        self.log = np.zeros(int(size.max()) + 1, np.int64)
        for i in range(2, len(self.log)):
            self.log[i] = self.log[i >> 1] + 1
        table = [np.arange(len(self.docs), dtype=np.int32)]
        for j in range(1, int(self.log[-1]) + 1):
            half, low = 1 << (j - 1), table[-1]
            high = np.r_[low[half:], low[len(low) - half:]] if half <= len(low) else low
            table.append(np.where(self.impact[low] >= self.impact[high], low, high))
        self.table = np.array(table)

    def best(self, a, b):
        """Place of the largest impact in [a, b) of the lists, -1 where it is empty."""
        import numpy as np
        n = b - a
        some = n > 0
        j = self.log[np.where(some, n, 1)]
        x = self.table[j, np.where(some, a, 0)]
        y = self.table[j, np.where(some, b - (1 << j), 0)]
        return np.where(some, np.where(self.impact[x] >= self.impact[y], x, y), -1)

    def search(self, terms: list[str], weights: list[int], top: int, floor: int, budget: int | None = None) -> list[tuple[int, object]]:
        """Up to ``top`` (score, doc_id), best first, of the documents that reach ``floor``; with a budget, of about so many scored."""
        import numpy as np
        got = [(self.number[t], w) for t, w in zip(terms, weights) if t in self.number and w > 0]
        if not got:
            return []
        mine, w = (np.array(x, np.int64) for x in zip(*got))
        base = mine * self.span
        a, b = self.begin[mine][None, :], self.begin[mine + 1][None, :]
        best = self.best(a, b)
        gain = np.where(best >= 0, self.impact[best], 0) * w
        bound = gain.sum(axis=1)
        kept_score, kept_doc = np.empty(0, np.int64), np.empty(0, np.int64)
        least, last, scored, splits = max(floor, 1), self.span, 0, 8
        first = np.zeros(1, np.int64)  # first document of each interval
        while True:
            # documents stand in the order of their ids, so among equal scores only earlier ones matter
            alive = (bound > least) | ((bound == least) & (first <= last))
            if not alive.any() or (budget is not None and scored >= budget):
                break
            if not alive.all():
                a, b, best, gain, bound, first = a[alive], b[alive], best[alive], gain[alive], bound[alive], first[alive]
            take = np.arange(len(bound)) if len(bound) <= splits else np.argpartition(-bound, splits)[:splits]
            ta, tb, tbest, tgain, tfirst = a[take], b[take], best[take], gain[take], first[take]
            doc = self.docs[tbest[np.arange(len(take)), tgain.argmax(axis=1)]]
            at = np.searchsorted(self.key, base + doc[:, None])
            has = (at < tb) & (self.docs[np.minimum(at, len(self.docs) - 1)] == doc[:, None])
            score = np.where(has, self.impact[np.minimum(at, len(self.docs) - 1)] * w, 0).sum(axis=1)
            scored += len(take)
            kept_score, kept_doc = np.r_[kept_score, score], np.r_[kept_doc, doc]
            order = np.lexsort((kept_doc, -kept_score))[:top]
            kept_score, kept_doc = kept_score[order], kept_doc[order]
            if len(order) == top and kept_score[-1] >= least:
                least, last = int(kept_score[-1]), int(kept_doc[-1])
            ca, cb, cfirst = np.concatenate([ta, at + has]), np.concatenate([at, tb]), np.concatenate([tfirst, doc + 1])
            cbest = self.best(ca, cb)
            cgain = np.where(cbest >= 0, self.impact[cbest], 0) * w
            cbound = cgain.sum(axis=1)
            use = cbound >= least
            rest = np.ones(len(bound), bool)
            rest[take] = False
            a, b, best, gain = (np.concatenate([x[rest], y[use]]) for x, y in ((a, ca), (b, cb), (best, cbest), (gain, cgain)))
            bound, first = np.r_[bound[rest], cbound[use]], np.r_[first[rest], cfirst[use]]
            splits = min(2 * splits, _SPLITS)
        good = kept_score >= max(floor, 1)
        return [(int(s), self.ids[d]) for s, d in zip(kept_score[good], kept_doc[good])]


def _answer(rows: DataFrame, queries: list[tuple], weights: dict[str, int], n_docs: int, n_terms: int, top: int,
            floor: dict, budget: int | None) -> DataFrame:
    """(q, doc_id, score) per segment; ``rows`` are index rows of the block's terms and the segments' documents."""
    def run(table):
        import pyarrow as pa
        term = table.column("term").to_pylist()
        own = term.index("")
        docs, tfs = table.column("docs").combine_chunks(), table.column("tfs").combine_chunks()
        lists = [i for i in range(len(term)) if i != own]
        out: list[tuple] = []
        if lists:
            import numpy as np
            arrays = lambda c: [c[i].values.to_numpy(zero_copy_only=False) for i in lists]
            seg = Lists([term[i] for i in lists], arrays(docs), arrays(tfs), table.column("ids")[own].values.to_pylist(),
                        np.asarray(tfs[own].values.to_numpy(zero_copy_only=False)), n_docs, n_terms)
            for q, terms in queries:
                out.extend((q, d, s) for s, d in seg.search(terms, [weights[t] for t in terms], top, floor.get(q, 0), budget))
        q, d, s = zip(*out) if out else ((), (), ())
        return pa.table({"q": pa.array(q, pa.int32()), "doc_id": pa.array(d, pa.int64()), "score": pa.array(s, pa.int64())})

    return rows.groupBy("segment").applyInArrow(run, "q int, doc_id long, score long")


def _first(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` of each query, taken in every task before the shuffle."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _blocks(queries: DataFrame) -> Iterator[list[tuple]]:
    """Bounded lists of (id, text)."""
    block, size = [], 0
    for r in queries.toLocalIterator():
        n = len(r[1] or "")
        if block and (len(block) >= BLOCK_QUERIES or size + n > BLOCK_CHARS):
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    if block:
        yield block


def search(index: DataFrame, queries: DataFrame, key: str = "item_id", top: int = TOP) -> DataFrame:
    """key, rank, doc_id, score: the ``top`` documents with a score above 0 of every row of ``queries``, against all documents."""
    spark = index.sparkSession
    ship(spark)
    kind = dict(queries.dtypes)[key]
    asked = queries.select(queries[key], queries["text"])
    n_docs, n_terms = totals(index)
    empty = spark.createDataFrame([], f"{key} {kind}, rank int, doc_id long, score long")
    answers = []
    for block in _blocks(asked) if n_terms else ():
        wanted = [(q, list(dict.fromkeys(terms_of(text)))) for q, (_, text) in enumerate(block)]
        terms = sorted({t for _, ts in wanted for t in ts})
        if not terms:
            continue
        known = F.broadcast(spark.createDataFrame([(t,) for t in terms], "term string"))  # terms of one block
        lists = materialize(index.where("term != ''").join(known, "term").select(*_COLUMNS), "lexical-block")
        df = {r["term"]: r["df"] for r in lists.groupBy("term").agg(F.sum(F.size("docs").cast("long")).alias("df")).collect()}
        weights = {t: weight(n_docs, df.get(t, 0)) for t in terms}
        rows = lists.unionByName(index.where("term = ''"))
        early = _first(_answer(rows, wanted, weights, n_docs, n_terms, top, {}, FIRST_ROUND), top).where(F.col("rank") == top)
        floor = {r["q"]: r["score"] for r in early.select("q", "score").collect()}
        found = _first(_answer(rows, wanted, weights, n_docs, n_terms, top, floor, None), top)
        names = F.broadcast(spark.createDataFrame(list(enumerate(k for k, _ in block)), f"q int, {key} {kind}"))  # one block
        answers.append(materialize(found.join(names, "q").select(key, "rank", "doc_id", "score"), "lexical-answers"))
    out = empty
    for x in answers:
        out = out.unionByName(x)
    return out


def _sql() -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    terms = f"regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {terms} AS t FROM documents),
s AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d),
p AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(t) AS term FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({terms}) AS term FROM benchmark)),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, n_docs),
m AS (SELECT row, doc_id, 10 + (90 * len(t) * n_docs) // n_terms AS m FROM d, s),
r AS (SELECT item_id, doc_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (row) GROUP BY item_id, doc_id, row)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= {TOP}
"""


ORACLE = _sql()
