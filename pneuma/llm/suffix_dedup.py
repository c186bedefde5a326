"""Suffix-array dedup: repeated byte strings across documents by bucket-pointer refinement.

A string of ``LENGTH`` bytes is a suffix position cut at that depth. Each such position belongs to
the initial bucket of the q-gram in it that has the least hash (its anchor), so equal
strings always share a bucket, and neighbouring positions with the same anchor form one stretch.

1. Stretches are dealt by anchor. Inside a bucket, equal stretches settle each other: all
   positions of a stretch that also stands in a smaller document are removed.
2. Buckets with different stretches are refined as in bucket-pointer refinement: positions are
   sorted into buckets by their first 8 bytes, then by the bucket identifiers of the positions
   8, 16 and 18 bytes later, each round on the identifiers that the last one made,
   down to depth ``LENGTH``. A final bucket holds equal strings; all but those of its
   smallest document are removed.
3. The removed positions meet their documents, and the covered bytes go.

Copies inside one map chunk are settled there, so a passage in a third of all documents
sends one stretch per chunk. Anchors that are very frequent in a sample of documents skip the buckets: their
positions are grouped by a 128-bit hash with map-side minima, so a common passage
between ever different neighbours does not meet in one task. The sample decides the
way only, never the result.

Null text is empty. Rows with a null doc_id neither lose nor cause anything. Repeated doc_ids are
not smaller than each other; repeated rows each get a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, materialize, ship

LENGTH = 50
Q = 16
#: Text bytes per map chunk, text bytes per bucket of stretches, and cut-out bytes per bucket of the refinement.
CHUNK = 2 << 20
BUCKET_BYTES = 32 << 20
REFINE_BYTES = 3 << 20
#: One document in SAMPLE is looked at for frequent anchors; so many stretches there make one frequent. What a task of
#: the refinement may have to hold of one anchor is thus about SAMPLE * FREQUENT stretches of 84 bytes at most, 5 MB.
SAMPLE = 32
FREQUENT = 2_000
_ROW = "bucket int, kind int, docs binary, rows binary"
#: Kinds of dealt rows and of settled ranges: to be settled or open, removed, of a frequent anchor.
OPEN, GONE, FREQUENT_KIND = 0, 1, 2
_SPAN = "doc_id long, tag long, start long, n long"


def _mix(x):
    import numpy as np
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _table():
    import numpy as np
    return _mix(_mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


_STEP = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)


def _hashes(data):
    """Hashes of the 16 and the 32 bytes from each position (meaningless where they would run out)."""
    import numpy as np
    with np.errstate(over="ignore"):
        h = _table()[data]
        out = []
        for k, m in enumerate(_STEP):
            size = 1 << k
            later = np.zeros_like(h)
            later[:-size or None] = h[size:]
            h = h * np.uint64(m) + later
            if k >= 2:
                h = _mix(h)
            if k >= 3:
                out.append(h)
    return out


def _pieces(texts: list[bytes], limit: int = CHUNK):
    """(document index, offset, bytes): long documents in parts that overlap by LENGTH - 1 bytes."""
    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        at = 0
        while True:
            yield i, at, t[at:at + limit + LENGTH - 1]
            at += limit
            if at + LENGTH > len(t):
                break


def stretches(texts: list[bytes]):
    """Arrays (document index, start, number of positions, anchor, content hash, position hash pair maker).

    Covers every position of every text once, in the order of the documents and starts.
    """
    import numpy as np
    empty = [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)] * 2
    parts, group, held = [], [], 0
    for p in _pieces(texts):
        if group and held + len(p[2]) > CHUNK + (CHUNK >> 1):
            parts.append(_stretch_group(group))
            group, held = [], 0
        group.append(p)
        held += len(p[2])
    if group:
        parts.append(_stretch_group(group))
    if not parts:
        return empty
    return [np.concatenate(x) for x in zip(*parts)]


def _stretch_group(group: list):
    import numpy as np
    data = np.frombuffer(b"".join(p[2] for p in group), dtype=np.uint8)
    size = np.array([len(p[2]) for p in group], dtype=np.int64)
    h16, h32 = _hashes(data)
    n = len(data)
    # Least hash of the q-grams inside each position's string; the low bits hold the place, so the first wins a tie.
    place_bits = np.uint64(26)
    key = (h16 >> place_bits << place_bits) | np.arange(n, dtype=np.uint64)
    m, width, want = key, 1, LENGTH - Q + 1
    while width < want:
        step = min(width, want - width)
        m = np.minimum(m[:len(m) - step], m[step:])
        width += step
    place = (m & np.uint64((1 << 26) - 1)).astype(np.int64)
    ends = np.cumsum(size)
    begin = ends - size
    valid = np.zeros(len(place), dtype=bool)
    change = np.ones(len(place), dtype=bool)
    change[1:] = place[1:] != place[:-1]
    # Positions whose string would leave its piece are not positions; every piece begins a stretch.
    bounds = np.zeros(n + 1, dtype=np.int32)
    np.add.at(bounds, begin, 1)
    np.add.at(bounds, ends - LENGTH + 1, -1)
    valid[:] = np.cumsum(bounds)[:len(place)] > 0
    change[begin[begin < len(change)]] = True
    at = np.nonzero(change & valid)[0]
    stop = np.nonzero(valid & ~np.append(valid[1:], False))[0] + 1
    following = np.append(at[1:], n)
    until = np.minimum(following, stop[np.searchsorted(stop, at, side="right")])
    count = until - at
    last = until - 1
    with np.errstate(over="ignore"):
        far = LENGTH - 32
        c = _mix(_mix(_mix(h32[at] * np.uint64(3) + h32[at + far]) * np.uint64(5) + h32[last]) * np.uint64(7)
                 + h32[last + far] + count.astype(np.uint64))
    which = np.searchsorted(ends, at, side="right")
    doc = np.array([p[0] for p in group], dtype=np.int64)[which]
    start = at - begin[which] + np.array([p[1] for p in group], dtype=np.int64)[which]
    return doc, start, count, h16[place[at]], c


def position_hashes(data):
    """128-bit names (two uint64 arrays) of the LENGTH-byte strings of a byte array."""
    import numpy as np
    _, h32 = _hashes(np.frombuffer(data, dtype=np.uint8))
    n = len(data) - LENGTH + 1
    with np.errstate(over="ignore"):
        a, b = h32[:n], h32[LENGTH - 32:][:n]
        return _mix(a * np.uint64(11) + b), _mix(b * np.uint64(13) ^ _mix(a))


def refine(data, size):
    """Bucket identifiers at depth LENGTH of all positions of concatenated strings of the given sizes.

    Only positions whose LENGTH bytes lie inside their string are meaningful. First the buckets of 8-byte grams, then
    each round sorts on pairs (own bucket, bucket some bytes later) of the round before.
    """
    import numpy as np
    n = len(data)

    def ranks(key):
        order = np.argsort(key)
        key = key[order]
        new = np.ones(n, dtype=bool)
        new[1:] = key[1:] != key[:-1]
        del key
        out = np.empty(n, dtype=np.uint32)
        out[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
        return out

    pad = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        key <<= np.uint64(8)
        key |= pad[k:k + n]
    bucket, depth = ranks(key), 8
    while depth < size:
        step = min(depth, size - depth)
        key = bucket.astype(np.uint64) << np.uint64(32)
        key[:max(0, n - step)] |= bucket[step:]
        bucket = ranks(key)
        depth += step
    return bucket.astype(np.int64)


def _six(x):
    """The low 6 bytes of uint64 values, packed."""
    import numpy as np
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unsix(raw):
    import numpy as np
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _runs(doc, tag, start, count):
    """Merge neighbouring position ranges of one document; rows must be sorted by (doc, tag, start)."""
    import numpy as np
    if not len(doc):
        return doc, tag, start, count
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > (start + count)[:-1])
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], tag[first], start[first], (start + count)[last] - start[first]


def _texts(batch):
    return [(t or "").encode() for t in batch.column(2).to_pylist()]


def _packed(source: DataFrame) -> DataFrame:
    """doc_id, tag and the text as zstandard bytes, for shuffles that carry whole texts."""
    def run(it: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches_by_bytes(it, "text", CHUNK):
            yield pa.record_batch([batch.column(0), batch.column(1),
                                   pa.array([squeeze(t) for t in _texts(batch)], pa.binary())], names=["doc_id", "tag", "z"])

    return source.mapInArrow(run, "doc_id long, tag long, z binary")


def _unpacked(batch):
    """The texts of packed rows, one at a time."""
    import zstandard
    stretch = zstandard.ZstdDecompressor().decompress
    return (stretch(z.as_py()) for z in batch.column(2))


def _source(docs: DataFrame) -> DataFrame:
    """doc_id, tag (tells apart rows of one doc_id) and text."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                       F.shiftrightunsigned(F.xxhash64(text), 33).alias("tag"), text.alias("text"))


def frequent_anchors(source: DataFrame, sample: int = SAMPLE, frequent: int = FREQUENT) -> list[int]:
    """Anchors with at least ``frequent`` stretches in one document of ``sample`` (chosen by hash): a short list."""
    def run(it: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for batch in batches_by_bytes(it, "text", CHUNK):
            a = stretches(_texts(batch))[3]
            name, n = np.unique(a, return_counts=True)
            yield pa.record_batch([pa.array(name.view(np.int64)), pa.array(n)], names=["anchor", "n"])

    some = source.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(sample)) == 0)
    rows = (some.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= frequent).select("anchor").collect())
    return [r[0] for r in rows]


def _deal(source: DataFrame, buckets: int, frequent: list[int]) -> DataFrame:
    """Stretches of all documents, settled inside each chunk, packed per (chunk, bucket).

    Ranges that are removed already and stretches of frequent anchors ride along in any bucket.
    """
    sent = source.sparkSession.sparkContext.broadcast(frequent)

    def run(it: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        hot = np.sort(np.array(sent.value, dtype=np.int64).view(np.uint64))
        for batch in batches_by_bytes(it, "text", CHUNK):
            ids = np.asarray(batch.column(0), dtype=np.int64)
            tags = np.asarray(batch.column(1), dtype=np.int64)
            where, start, count, anchor, content = stretches(_texts(batch))
            doc, tag = ids[where], tags[where]
            order = np.lexsort((start, tag, doc))
            doc, tag, start, count, anchor, content = (x[order] for x in (doc, tag, start, count, anchor, content))
            # Equal stretches of this chunk: those of its smallest document go on, the others are settled.
            by = np.lexsort((doc, content, anchor))
            new = np.ones(len(by), dtype=bool)
            new[1:] = (anchor[by][1:] != anchor[by][:-1]) | (content[by][1:] != content[by][:-1])
            least = doc[by][np.nonzero(new)[0]][np.cumsum(new) - 1] if len(by) else doc
            gone = np.zeros(len(by), dtype=bool)
            gone[by] = doc[by] > least
            out = []
            if gone.any():
                any_bucket = int(content[gone][0] % np.uint64(buckets))
                out.append((any_bucket, GONE, *_pack(*_runs(doc[gone], tag[gone], start[gone], count[gone]), None, None)))
            keep = np.nonzero(~gone)[0]
            bucket = (_mix(anchor[keep]) % np.uint64(buckets)).astype(np.int64)
            if len(hot):
                often = np.isin(anchor[keep], hot)
                rows = keep[often]
                if len(rows):
                    out.append((int(content[rows[0]] % np.uint64(buckets)), FREQUENT_KIND,
                                *_pack(doc[rows], tag[rows], start[rows], count[rows], None, None)))
                keep, bucket = keep[~often], bucket[~often]
            ranked = np.argsort(bucket, kind="stable")
            edges = np.nonzero(np.diff(bucket[ranked], prepend=-9))[0]
            for b, rows in zip(bucket[ranked][edges], np.split(keep[ranked], edges[1:]) if len(edges) else []):
                out.append((int(b), OPEN, *_pack(doc[rows], tag[rows], start[rows], count[rows], anchor[rows], content[rows])))
            if out:
                cols = list(zip(*out))
                yield pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()),
                                       pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())],
                                      names=["bucket", "kind", "docs", "rows"])

    return source.where("doc_id is not null").mapInArrow(run, _ROW)


def _pack(doc, tag, start, count, anchor, content):
    """(document table, rows) as bytes; rows are sorted by document, so a table of counts names them."""
    import numpy as np
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    first = np.nonzero(new)[0]
    per = np.diff(np.append(first, len(doc)))
    ids = doc[first]
    docs = (len(first).to_bytes(4, "little") + np.diff(ids, prepend=0).astype("<i8").tobytes()
            + tag[first].astype("<u4").tobytes() + per.astype("<u4").tobytes())
    # Starts as differences, byte plane by byte plane: the high planes are zeros and vanish in the shuffle's compression.
    step = np.diff(start, prepend=0)
    size = 8 if len(step) and (step.max() >= 1 << 31 or step.min() < -(1 << 31)) else 4
    body = step.astype(f"<i{size}").view(np.uint8).reshape(-1, size).T.tobytes()
    wide = bytes([size])
    if anchor is None:
        return docs, wide + body + count.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    five = np.ascontiguousarray(content.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()
    return docs, wide + body + count.astype(np.uint8).tobytes() + _six(anchor) + five


def _unpack(docs: bytes, rows: bytes, named: bool):
    import numpy as np
    n = int.from_bytes(docs[:4], "little")
    ids = np.cumsum(np.frombuffer(docs, "<i8", n, 4))
    tags = np.frombuffer(docs, "<u4", n, 4 + 8 * n).astype(np.int64)
    per = np.frombuffer(docs, "<u4", n, 4 + 12 * n).astype(np.int64)
    total = int(per.sum())
    doc, tag = np.repeat(ids, per), np.repeat(tags, per)
    size = rows[0]

    def planes(at: int, size: int):
        raw = np.frombuffer(rows, np.uint8, size * total, at).reshape(size, total).T
        return np.ascontiguousarray(raw).reshape(-1).view(f"<i{size}").astype(np.int64)

    start = np.cumsum(planes(1, size))
    at = 1 + size * total
    if not named:
        return doc, tag, start, planes(at, 8)
    count = np.frombuffer(rows, np.uint8, total, at).astype(np.int64)
    anchor = _unsix(rows[at + total:at + 7 * total])
    five = np.zeros((total, 8), dtype=np.uint8)
    five[:, :5] = np.frombuffer(rows, np.uint8, 5 * total, at + 7 * total).reshape(-1, 5)
    return doc, tag, start, count, anchor, five.reshape(-1).view("<u8")


def _settle(dealt: DataFrame, buckets: int) -> DataFrame:
    """Position ranges (doc_id, tag, start, n, anchor, kind): removed, open (with their anchor) or of a frequent anchor.

    Open are, for an anchor with different stretches in different documents, the stretches of each
    content's smallest document: what further bytes decide.
    """
    def run(it: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def table(kind, doc, tag, start, count, anchor=None):
            return pa.record_batch([pa.array(doc), pa.array(tag), pa.array(start), pa.array(count),
                                    pa.nulls(len(doc), pa.int64()) if anchor is None else pa.array(anchor.view(np.int64)),
                                    pa.array(np.full(len(doc), kind, np.int32))],
                                   names=["doc_id", "tag", "start", "n", "anchor", "kind"])

        parts: dict[int, list] = {}
        for batch in it:
            for b, kind, docs, rows in zip(*(c.to_pylist() for c in batch.columns)):
                if kind != OPEN:
                    yield table(kind, *_unpack(docs, rows, False))
                else:
                    parts.setdefault(b, []).append((docs, rows))
        for b in sorted(parts):
            one = [_unpack(docs, rows, True) for docs, rows in parts.pop(b)]
            yield from settle(table, *(np.concatenate(x) for x in zip(*one)))

    def settle(table, doc, tag, start, count, anchor, content):
        import numpy as np
        by = np.lexsort((doc, content, anchor))
        doc, tag, start, count, anchor, content = (x[by] for x in (doc, tag, start, count, anchor, content))
        new_anchor = np.ones(len(doc), dtype=bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new = new_anchor.copy()
        new[1:] |= content[1:] != content[:-1]
        group = np.cumsum(new) - 1
        gone = doc > doc[np.nonzero(new)[0]][group]
        of_anchor = np.cumsum(new_anchor) - 1
        firsts = np.nonzero(new_anchor)[0]
        contents = np.add.reduceat(new, firsts)
        low, high = np.minimum.reduceat(doc, firsts), np.maximum.reduceat(doc, firsts)
        open_ = ((contents > 1) & (low < high))[of_anchor] & ~gone
        # Several equal stretches of the smallest document are all kept open: each has its own place.
        for some, kind in ((gone, GONE), (open_, OPEN)):
            i = np.nonzero(some)[0]
            for k in range(0, len(i), 100_000):
                j = i[k:k + 100_000]
                yield table(kind, doc[j], tag[j], start[j], count[j], anchor[j] if kind == OPEN else None)

    return dealt.repartition(buckets, "bucket").mapInArrow(run, f"{_SPAN}, anchor long, kind int")


def _cut_contents(packed: DataFrame, spans: DataFrame, buckets: int) -> DataFrame:
    """The bytes of open and of frequent stretches, packed per (chunk, bucket, kind); written once."""
    def run(it: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for batch in batches_by_bytes(it, "z", CHUNK >> 1):
            doc, tag, start, count, anchor, kind, bytes_ = [], [], [], [], [], [], []
            for d, t, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _unpacked(batch),
                                       batch.column(3).to_pylist()):
                for x in own:
                    doc.append(d)
                    tag.append(t)
                    start.append(x["start"])
                    count.append(x["n"])
                    anchor.append(x["anchor"] or 0)
                    kind.append(x["kind"])
                    bytes_.append(text[x["start"]:x["start"] + x["n"] + LENGTH - 1])
            if not doc:
                continue
            doc, tag, start, count, kind = (np.array(x, dtype=np.int64) for x in (doc, tag, start, count, kind))
            bucket = (_mix(np.array(anchor, dtype=np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            bucket[kind == FREQUENT_KIND] = doc[0] % buckets
            order = np.lexsort((start, tag, doc, kind, bucket))
            group = bucket[order] * 4 + kind[order]
            edges = np.nonzero(np.diff(group, prepend=-1))[0]
            out = []
            for i, e in enumerate(edges):
                by = order[e:edges[i + 1] if i + 1 < len(edges) else None]
                out.append((int(bucket[by[0]]), int(kind[by[0]]), *_pack(doc[by], tag[by], start[by], count[by], None, None),
                            b"".join(bytes_[j] for j in by)))
            cols = list(zip(*out))
            yield pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()),
                                   *(pa.array(c, pa.binary()) for c in cols[2:])],
                                  names=["bucket", "kind", "docs", "rows", "bytes"])

    lists = spans.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "n", "anchor", "kind")).alias("spans"))
    return materialize(packed.join(lists.hint("shuffle_hash"), ["doc_id", "tag"]).select("doc_id", "tag", "z", "spans")
                       .mapInArrow(run, f"{_ROW}, bytes binary"), "stretches")


def repeats(doc, tag, start, count, flat):
    """(doc, tag, start) of the positions whose LENGTH bytes also start in a smaller document, by refinement of one bucket's stretches.

    ``flat`` holds the bytes of the stretches one after the other. Equal strings have equal hashes, so a position whose hash
    no other document shares is a bucket of its own at once; only the bytes around the others are refined.
    """
    import numpy as np
    size = count + LENGTH - 1
    row = np.repeat(np.arange(len(count)), count)
    at = (np.cumsum(size) - size - np.cumsum(count) + count)[row] + np.arange(len(row))
    own = doc[row]
    name = position_hashes(flat)[0][at]
    by = np.argsort(name)
    new = np.ones(len(by), dtype=bool)
    new[1:] = name[by][1:] != name[by][:-1]
    first = np.nonzero(new)[0]
    several = np.minimum.reduceat(own[by], first) < np.maximum.reduceat(own[by], first)
    some = np.sort(by[several[np.cumsum(new) - 1]])
    if not len(some):
        return own[some], tag[row[some]], at[some]
    # Runs of bytes that hold the strings of these positions; a gap that the strings reach over stays inside.
    at, own, row = at[some], own[some], row[some]
    begins = np.nonzero(np.diff(at, prepend=-LENGTH) >= LENGTH)[0]
    until = at[np.append(begins[1:], len(at)) - 1] + LENGTH
    held = until - at[begins]
    moved = np.cumsum(held) - held - at[begins]  # from a run's place in flat to its place in what is refined
    bytes_ = flat[np.arange(int(held.sum())) - np.repeat(moved, held)]
    run = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(at))))
    bucket = refine(bytes_, LENGTH)[at + moved[run]]
    least = np.full(int(bucket.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, bucket, own)
    gone = own > least[bucket]
    inside = at - (np.cumsum(size) - size)[row]
    return own[gone], tag[row[gone]], (start[row] + inside)[gone]


def _refine_buckets(cut: DataFrame, buckets: int) -> DataFrame:
    """Removed position ranges of the open stretches, by refinement inside each bucket."""
    def run(it: Iterator) -> Iterator:
        parts: dict[int, list] = {}
        for batch in it:
            for b, docs, rows, raw in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                parts.setdefault(b, []).append((docs, rows, raw))
        for b in sorted(parts):
            yield from one_bucket(parts.pop(b))

    def one_bucket(parts: list) -> Iterator:
        import numpy as np
        import pyarrow as pa
        doc, tag, start, count = (np.concatenate(x) for x in zip(*(_unpack(d, r, False) for d, r, _ in parts)))
        d, t, s = repeats(doc, tag, start, count, np.frombuffer(b"".join(raw for _, _, raw in parts), dtype=np.uint8))
        if len(d):
            by = np.lexsort((s, t, d))
            out = _runs(d[by], t[by], s[by], np.ones(len(by), np.int64))
            yield pa.record_batch([pa.array(x) for x in out], names=["doc_id", "tag", "start", "n"])

    return cut.where(F.col("kind") == OPEN).repartition(buckets, "bucket").mapInArrow(run, _SPAN)


def _frequent_positions(cut: DataFrame) -> DataFrame:
    """Removed ranges of the frequent anchors' stretches: grouped minima over hashed positions, map-side first."""
    def run(it: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for batch in it:
            for docs, rows, raw in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                doc, tag, start, count = _unpack(docs, rows, False)
                size = count + LENGTH - 1
                row = np.repeat(np.arange(len(count)), count)
                inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                at = (np.cumsum(size) - size)[row] + inside
                a, b = position_hashes(raw)
                yield pa.record_batch([pa.array(x) for x in (a[at].view(np.int64), b[at].view(np.int64), doc[row], tag[row],
                                                             start[row] + inside)], names=["a", "b", "doc_id", "tag", "start"])

    named = cut.where(F.col("kind") == FREQUENT_KIND).mapInArrow(run, "a long, b long, doc_id long, tag long, start long")
    least = named.groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    return (named.join(least, ["a", "b"]).where("doc_id > least")
            .select("doc_id", "tag", "start", F.lit(1).cast("long").alias("n")))


def removed_positions(source: DataFrame, packed: DataFrame, bucket_bytes: int = BUCKET_BYTES,
                      refine_bytes: int = REFINE_BYTES, sample: int = SAMPLE, frequent: int = FREQUENT) -> DataFrame:
    """Ranges of positions (doc_id, tag, start, n) whose LENGTH bytes also start in a smaller document."""
    spark = source.sparkSession
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, -(-total // bucket_bytes))
    hot = frequent_anchors(source, sample, frequent)
    settled = materialize(_settle(_deal(source, buckets, hot), buckets), "settled")
    open_bytes = settled.where(F.col("kind") == OPEN).agg(F.sum(F.col("n") + LENGTH - 1)).first()[0] or 0
    fine = max(least, -(-open_bytes // refine_bytes))
    cut = _cut_contents(packed, settled.where(F.col("kind") != GONE), fine)
    found = settled.where(F.col("kind") == GONE).select("doc_id", "tag", "start", "n").union(_refine_buckets(cut, fine))
    return found.union(_frequent_positions(cut)) if hot else found


def dedup(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte ranges, one row per row of ``docs``.

    ``options`` are those of ``removed_positions``; they change the way, never the result.
    """
    ship(docs.sparkSession)
    source = _source(docs)
    packed = _packed(source)

    def run(it: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for batch in batches_by_bytes(it, "z", CHUNK):
            out = []
            for d, text, starts, counts in zip(batch.column(0).to_pylist(), _unpacked(batch), batch.column(3), batch.column(4)):
                if starts.values is None or not len(starts.values):
                    out.append((d, len(text), 0, 0, hashlib.sha256(text).hexdigest(), []))
                    continue
                s = np.asarray(starts.values)
                e = s + np.asarray(counts.values) + LENGTH - 1
                by = np.argsort(s, kind="stable")
                s, e = s[by], np.maximum.accumulate(e[by])
                new = np.ones(len(s), dtype=bool)
                new[1:] = s[1:] > e[:-1]
                first = np.nonzero(new)[0]
                begin, end = s[first], e[np.append(first[1:], len(s)) - 1]
                digest, at = hashlib.sha256(), 0
                for x, y in zip(begin.tolist(), end.tolist()):
                    digest.update(text[at:x])
                    at = y
                digest.update(text[at:])
                out.append((d, len(text), int((end - begin).sum()), len(begin), digest.hexdigest(),
                            [{"start": x, "end": y} for x, y in zip(begin.tolist(), end.tolist())]))
            cols = list(zip(*out))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)],
                                  names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    spans = removed_positions(source, packed, **options).groupBy("doc_id", "tag").agg(
        F.collect_list("start").alias("starts"), F.collect_list("n").alias("counts"))
    return (packed.join(spans.hint("shuffle_hash"), ["doc_id", "tag"], "left")
            .select("doc_id", "tag", "z", "starts", "counts")
            .mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                             "removed array<struct<start:long,end:long>>"))
