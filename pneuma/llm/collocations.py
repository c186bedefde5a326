"""Phrase collocations per language by dynamic itemset counting.

The texts are dealt to a few shards, which are scanned in a cycle. Words are counted from the first
scan on; a longer phrase is activated as soon as both phrases that lack its last or its first word have
reached the threshold, whatever shard that happens in, and is counted for one full cycle of
shards from there. Lengths are thus counted side by side, and the cycles end when no phrase is
within its cycle. Phrases of the greatest length activate none; they are counted in the last scan.

In the cycles, counts stand in a table of hashed counters of bounded size (``counters`` at most, whatever the
corpus): a counter is at least the count of each of its phrases. Tasks know the counters that
reached the threshold as a bitmap. It only gains bits, so a phrase that passes does so in all
later scans, and it is counted in a scan if it passes now and did not pass a cycle ago: each phrase
that is counted at all is counted in every shard exactly once. The last scan counts the phrases whose counter reached the
threshold by their words; these counts are exact. Phrases that share a counter cost that scan a few more rows and change no count.

Null text is empty, null language is ``und``; phrases never cross a row or a separator. Repeated rows
count each time. An empty table gives an empty result. A word or a text of any length is taken whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shared_path, ship
from .units import Hasher

MAX_WORDS = 5
THRESHOLD = 100
TOP = 2000
SHARDS = 3
#: Largest and smallest table of counters; between them it has one counter per 64 bytes of text.
COUNTERS, LEAST_COUNTERS = 1 << 27, 1 << 16
#: Counters that travel in one row, and into how many groups the rows of one slice are dealt before they are summed.
SLICE, FAN = 1 << 14, 64
#: Text of one language that a task takes up at once, all the text that it holds, and phrases that it sums before it hands them on.
CHUNK_BYTES, HELD_BYTES, HELD_PHRASES = 3 << 20, 12 << 20, 600_000
#: Separators of pieces, as one byte that UTF-8 never has; A-Z in lower case.
_BREAK = b"\xff"
_TRANSLATE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + _BREAK * 10)
_GAP = re.compile(rb"[ \t\xff]")


def tokens(data: bytes):
    """The words of a translated text in order as an Arrow array of bytes, with a ``_BREAK`` for every separator."""
    import pyarrow as pa
    import pyarrow.compute as pc
    spaced = data.replace(_BREAK, b" " + _BREAK + b" ").strip(b" \t")
    if not spaced:
        return pa.array([], pa.binary())
    return pc.ascii_split_whitespace(pa.array([spaced], pa.binary()).view(pa.string())).values.view(pa.binary())


def cut(data: bytes, limit: int) -> Iterator[bytes]:
    """Slices of about ``limit`` bytes that end after a gap, so that no word is cut."""
    begin = 0
    while len(data) - begin > limit:
        m = _GAP.search(data, begin + limit)
        if m is None:
            break
        yield data[begin:m.end()]
        begin = m.end()
    yield data[begin:]


_HASHER = Hasher(5)


def word_hashes(words, lang: str):
    """A 64-bit hash of every word of an Arrow array of bytes, different for each language."""
    import zlib

    import numpy as np
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    first = offsets[0] if len(offsets) else 0
    data = np.frombuffer(data, np.uint8)[first:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    h = _HASHER(data, offsets[:-1] - first, offsets[1:] - first) + np.uint64(zlib.crc32(lang.encode()))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def longer(before, word):
    """Hash of a phrase from the hash of all but its last word and the hash of that word."""
    import numpy as np
    h = (before ^ (before >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word
    return h ^ (h >> np.uint64(32))


def places(h, counters: int):
    """The counter of every hash."""
    import numpy as np
    return (h >> np.uint64(64 - (counters.bit_length() - 1))).astype(np.int64)


def passes(bitmap, at):
    """For every counter whether it has reached the threshold (bytes of the bitmap, or None: none has)."""
    import numpy as np
    if bitmap is None:
        return np.zeros(len(at), bool)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class Chunk:
    """Words of a chunk in order with their numbers, and for each length the starts of the phrases that pass ``now``.

    The first ``carry`` words were counted before; only phrases that reach beyond them count.
    """

    def __init__(self, words, carry: int, lang: str, counters: int, now, old=None):
        import numpy as np
        import pyarrow.compute as pc
        named = words.dictionary_encode()
        self.names, self.code = named.dictionary, named.indices.to_numpy().astype(np.int64)
        self.carry, self.counters, self.now, self.old = carry, counters, now, old
        self.breaks = pc.equal(self.names, _BREAK).to_numpy(zero_copy_only=False)
        self.hashes = word_hashes(self.names, lang)
        self.at = places(self.hashes, counters)

    def word_counts(self):
        """Per distinct word how often it occurs, 0 for breaks."""
        import numpy as np
        n = np.bincount(self.code[self.carry:], minlength=len(self.names))
        n[self.breaks] = 0
        return n

    def phrases(self, longest: int) -> Iterator[tuple]:
        """(length, starts, counters) of the phrases to count, for lengths from 2: both shorter phrases pass now, and did not a cycle ago."""
        import numpy as np
        if self.now is None:
            return
        start, h, at = np.arange(len(self.code)), self.hashes[self.code], self.at[self.code]
        on, was = (passes(self.now, self.at) & ~self.breaks)[self.code], (passes(self.old, self.at) & ~self.breaks)[self.code]
        for k in range(2, longest + 1):
            # the next phrase starts where this one and its neighbour both pass
            follows = np.flatnonzero((start[1:] == start[:-1] + 1) & on[1:] & on[:-1])
            if not len(follows):
                return
            start, done = start[follows], was[follows] & was[follows + 1]
            h = longer(h[follows], self.hashes[self.code[start + k - 1]])
            at = places(h, self.counters)
            wanted = ~done & (start + k > self.carry)
            yield k, start[wanted], at[wanted]
            on, was = passes(self.now, at), passes(self.old, at) & done

    def named(self, k: int, start) -> tuple:
        """The distinct phrases of ``k`` words at ``start``, told apart by their words, how often each occurs, and where in ``start`` first."""
        import numpy as np
        import pandas as pd
        import pyarrow as pa
        import pyarrow.compute as pc
        ids = self.code[start]
        for j in range(1, k):
            ids, _ = pd.factorize(ids * len(self.names) + self.code[start + j])
        n = np.bincount(ids)
        first = np.zeros(len(n), np.int64)
        first[ids[::-1]] = np.arange(len(start))[::-1]
        at = start[first]
        return pc.binary_join_element_wise(*(self.names.take(pa.array(self.code[at + j])) for j in range(k)), b" "), n, first


def _chunks(it: Iterator) -> Iterator[tuple]:
    """(lang, words, carry) over the batches of (lang, text): chunks of one language, each led by the last words of the one before."""
    texts: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}

    def take(lang: str):
        size.pop(lang)
        data, before = _BREAK.join(texts.pop(lang)).translate(_TRANSLATE), []
        for part in cut(data, CHUNK_BYTES):
            words = tokens(b" ".join([*before, part]))
            if len(words):
                yield lang, words, len(before)
            before = words[max(0, len(words) - MAX_WORDS + 1):].to_pylist()

    for batch in it:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = text.as_buffer().to_pybytes()
            texts.setdefault(lang, []).append(data)
            size[lang] = size.get(lang, 0) + len(data)
            if size[lang] > CHUNK_BYTES:
                yield from take(lang)
            elif sum(size.values()) > HELD_BYTES:
                yield from take(max(size, key=size.get))
    for lang in list(texts):
        yield from take(lang)


def _kind(threshold: int) -> str:
    """Type of a counter; it stops at the threshold."""
    return "uint8" if threshold < 1 << 8 else "uint16" if threshold < 1 << 16 else "uint32"


def _scan(shard: DataFrame, now, old, count_words: bool, counters: int, threshold: int) -> DataFrame:
    """(slice, part, counts): the counters that one shard's tasks have raised, those of a task in rows of ``SLICE`` counters."""
    kind = _kind(threshold)

    def run(it: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        new, past = now.value if now else None, old.value if old else None
        table, part = np.zeros(counters, kind), TaskContext.get().partitionId() % FAN

        def add(at, n=None):
            at, where = np.unique(at, return_inverse=True)
            n = np.bincount(where, n)
            table[at] = np.minimum(table[at] + n, threshold).astype(kind)

        for lang, words, carry in _chunks(it):
            chunk = Chunk(words, carry, lang, counters, new, past)
            if count_words:
                add(chunk.at, chunk.word_counts())
            for _, start, at in chunk.phrases(MAX_WORDS - 1):
                if len(start):
                    add(at)
        width = min(SLICE, counters)
        for i in np.flatnonzero(table.reshape(-1, width).any(axis=1)).tolist():
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([part], pa.int32()),
                                   pa.array([table[i * width:(i + 1) * width].tobytes()], pa.binary())], names=["slice", "part", "counts"])

    return shard.select("lang", "text").mapInArrow(run, "slice int, part int, counts binary")


def _sum(rows: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    """The slices of each key summed; ``reached`` has a bit per counter."""
    kind = _kind(threshold)

    def run(group):
        import numpy as np
        import pyarrow as pa
        total = None
        for x in group.column("counts"):
            one = np.frombuffer(x.as_buffer(), kind).astype(np.uint64)
            total = one if total is None else np.minimum(total + one, np.uint64(threshold))
        reached = np.packbits(total >= threshold, bitorder="little")
        return pa.table({"slice": group.column("slice")[:1], "part": group.column("part")[:1],
                         "counts": pa.array([total.astype(kind).tobytes()], pa.binary()), "reached": pa.array([reached.tobytes()], pa.binary())})

    return rows.groupBy(*keys).applyInArrow(run, "slice int, part int, counts binary, reached binary")


def _suspects(texts: DataFrame, bitmap, counters: int, threshold: int) -> DataFrame:
    """(lang, phrase, n): words and phrases counted by their words, of those whose counter reached the threshold; an empty phrase has all words.

    A task sums its counts and hands them on as one compressed table per slice of the phrases, of which there are a few for each
    shuffle partition; the tables of a slice are summed where they meet.
    """
    slices = 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(it: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        now, held, size = bitmap.value if bitmap else None, [], 0
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))

        def rows(lang, phrases, n, at):
            return pa.table({"slice": pa.array(at % slices), "lang": pa.repeat(pa.scalar(lang, pa.string()), len(n)),
                             "phrase": phrases.cast(pa.binary()), "n": pa.array(n, pa.int64())})

        def flush():
            whole = _summed(pa.concat_tables(held), ["slice", "lang", "phrase"]).sort_by([("slice", "ascending"), ("phrase", "ascending")])
            number = whole.column("slice").to_numpy()
            edges = np.r_[np.flatnonzero(np.r_[True, np.diff(number) != 0]), len(number)]
            for a, b in zip(edges, edges[1:]):
                part = whole.slice(a, b - a).drop_columns(["slice"]).combine_chunks()
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, part.schema, options=options) as w:
                    w.write_table(part)
                yield pa.record_batch([pa.array([number[a]], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())],
                                      names=["slice", "counts"])

        for lang, words, carry in _chunks(it):
            chunk = Chunk(words, carry, lang, counters, now)
            n = chunk.word_counts()
            some = np.flatnonzero((n > 0) & passes(now, chunk.at))
            new = [rows(lang, pa.array([b""], pa.binary()), n.sum(keepdims=True), np.zeros(1, np.int64)),
                   rows(lang, chunk.names.take(pa.array(some)), n[some], chunk.at[some])]
            for k, start, at in chunk.phrases(MAX_WORDS):
                if k < MAX_WORDS:
                    own = passes(now, at)
                    start, at = start[own], at[own]
                if len(start):
                    phrases, n, first = chunk.named(k, start)
                    new.append(rows(lang, phrases, n, at[first]))
            held += new
            size += sum(len(x) for x in new)
            if size > HELD_PHRASES:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def merge(group):
        import pyarrow as pa
        import pyarrow.compute as pc
        whole = _summed(pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in group.column("counts")]), ["lang", "phrase"])
        whole = whole.filter(pc.or_(pc.greater_equal(whole.column("n"), threshold), pc.equal(whole.column("phrase"), b"")))
        whole = whole.combine_chunks()
        phrase = pa.chunked_array([c.view(pa.string()) for c in whole.column("phrase").chunks], pa.string())
        return pa.table({"lang": whole.column("lang"), "phrase": phrase, "n": whole.column("n")})

    packed = texts.select("lang", "text").mapInArrow(run, "slice long, counts binary")
    return packed.groupBy("slice").applyInArrow(merge, "lang string, phrase string, n long")


def _summed(table, keys: list[str]):
    return table.group_by(keys).aggregate([("n", "sum")]).rename_columns([*keys, "n"])


def _length(phrase: str) -> Column:
    """Words of a phrase; 0 for the one that stands for all words."""
    c = F.col(phrase)
    return F.when(c == "", 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1)


def frequent_phrases(docs: DataFrame, threshold: int = THRESHOLD, shards: int = SHARDS, counters: int = COUNTERS) -> DataFrame:
    """lang, phrase, n: phrases of 1 to 5 words found ``threshold`` times or more, with their exact counts.

    The row whose phrase is empty has the count of all words. Each scan of the cycles reads one shard and shuffles the slices of its
    tasks' counters, summed in two steps.
    """
    import numpy as np
    spark = docs.sparkSession
    ship(spark)
    path = shared_path(spark, "collocation-shards")
    (docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), docs["text"]).where("text is not null and text != ''")
     .withColumn("shard", F.monotonically_increasing_id() % shards).write.partitionBy("shard").parquet(path))
    texts = spark.read.schema("lang string, text string, shard int").parquet(path)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counters = min(counters, max(LEAST_COUNTERS, 1 << (size // 64).bit_length()))
    maps: list = [None]  # after no scan, after scan 0, ...; the same object where no counter came in
    bits, table, step = np.zeros(counters // 8, np.uint8), None, 0
    while step < shards or maps[step] is not maps[max(step - shards, 0)]:
        now, old = maps[step], maps[max(step - shards, 0)]
        seen = _sum(_scan(texts.where(F.col("shard") == step % shards), now, old, step < shards, counters, threshold), ["slice", "part"], threshold)
        if table is not None:
            seen = seen.unionByName(table)
        table = materialize(_sum(seen, ["slice"], threshold), "collocation-counters")
        fresh, width = np.zeros_like(bits), min(SLICE, counters) // 8
        for r in table.select("slice", "reached").toLocalIterator():  # counters / 8 bytes at most
            fresh[r["slice"] * width:(r["slice"] + 1) * width] = np.frombuffer(r["reached"], np.uint8)
        if (fresh != bits).any():
            bits = fresh
            maps.append(spark.sparkContext.broadcast(bits))
        else:
            maps.append(maps[-1])
        step += 1
        if step > shards and maps[step - shards - 1] and maps[step - shards - 1] is not maps[step - shards]:
            maps[step - shards - 1].destroy()  # no later scan looks that far back, and the counters are stored
    return materialize(_suspects(texts, maps[-1], counters, threshold), "collocation-counts")


def collocations(docs: DataFrame, threshold: int = THRESHOLD, shards: int = SHARDS, counters: int = COUNTERS) -> DataFrame:
    """All kept candidates: lang, phrase, a, l, r, n, score.

    A candidate's score is that of its lowest-scoring cut (the first such cut). It is dropped if a longer candidate that
    holds it is as frequent; then one with a single word more is, too, so only those are looked at.
    """
    found = frequent_phrases(docs, threshold, shards, counters).withColumn("k", _length("phrase"))
    words = found.where("phrase = ''").select("lang", F.col("n").alias("words"))
    parts = found.where("phrase != ''").select("lang", "phrase", F.col("n").alias("f"))
    cands = found.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"))

    cuts = cands.withColumn("_j", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).withColumns({
        "_left": F.expr("substring_index(phrase, ' ', _j)"), "_right": F.expr("substring_index(phrase, ' ', _j - k)")})
    cuts = (cuts.join(parts.select("lang", F.col("phrase").alias("_left"), F.col("f").alias("l")), ["lang", "_left"])
            .join(parts.select("lang", F.col("phrase").alias("_right"), F.col("f").alias("r")), ["lang", "_right"])
            .join(F.broadcast(words), "lang"))  # one row per language
    wide = "decimal(19,0)"
    score = F.expr(f"(cast(1000 * a as {wide}) * cast(words as {wide})) div (cast(l as {wide}) * cast(r as {wide}))")
    best = (cuts.withColumn("score", score).groupBy("lang", "phrase", "k", "a", F.col("words").alias("n"))
            .agg(F.min(F.struct("score", "_j", "l", "r")).alias("c")))
    ends = cands.where("k > 2").select("lang", "a", F.explode(F.array(
        F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)"))).alias("phrase"))
    inside = ends.groupBy("lang", "phrase").agg(F.max("a").alias("_most"))
    return (best.join(inside, ["lang", "phrase"], "left").where("_most is null or _most < a")
            .select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score")))


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language with their rank; the limit is taken in every task before the shuffle."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


ORACLE = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS row,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
words AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
      FROM w, range(1, {MAX_WORDS + 1}) r(k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= {THRESHOLD}),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1),
cuts AS (SELECT c.*, j, array_to_string(w[1:j], ' ') AS lp, array_to_string(w[j + 1:k], ' ') AS rp FROM c, range(1, {MAX_WORDS}) r(j) WHERE j < k),
s AS (SELECT c.lang, c.phrase, c.k, c.a, c.j, x.f AS l, y.f AS r, words.n,
        ((1000::HUGEINT * c.a * words.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp
      JOIN words ON words.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.lang = b.lang AND x.k > b.k AND 100 * x.a >= 100 * b.a
           AND contains(' ' || x.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= {TOP}
"""
