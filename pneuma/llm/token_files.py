"""Token files: documents as token ids in patched frame-of-reference blocks.

One shard file (little-endian throughout):

    magic 'PFR1' | block_ids u32 | n_docs u64 | n_ids u64 | n_blocks u64
    doc_id i64[n_docs] | doc_null u8[n_docs] | n_tokens u64[n_docs]
    block_start u64[n_blocks + 1]           offsets of the blocks in the body
    body: per block  min u32 | width u8 | n_exceptions u16
                     packed values (block_ids * width bits, rounded up to bytes)
                     exception positions u16[n] | exception values u32[n]

A block holds ``block_ids`` ids (the last one is padded with its minimum). The block
minimum is subtracted; the width is that of the chosen percentile of the differences;
larger differences are exceptions, stored whole, with zero in the packed part. The
block index lets a reader start at any id.

Shards follow ascending doc_id; the manifest gives each shard's first id and first
document, so a global position is a shard start plus a position inside.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_by_bytes, shared_path, ship
from .units import TextEncoder

VOCABULARY_FILE = "byte_bpe_50k.json"
END_ID = 2
BLOCK_IDS = 1024
#: Share of a block's differences that the packed width must hold.
PERCENTILE = 0.9
#: A shard is closed at the end of the document that brings it to this many ids.
SHARD_IDS = 4_000_000
_HEAD = struct.Struct("<4sIQQQ")
_BLOCK = struct.Struct("<IBH")


def pack_blocks(ids, block_ids: int = BLOCK_IDS, percentile: float = PERCENTILE):
    """(body bytes, block starts) of a uint32 array."""
    import numpy as np
    n = len(ids)
    blocks = -(-n // block_ids)
    starts = np.zeros(blocks + 1, dtype="<u8")
    body: list[bytes] = []
    at = 0
    step = 512
    for b0 in range(0, blocks, step):
        part = ids[b0 * block_ids:(b0 + step) * block_ids]
        rows = -(-len(part) // block_ids)
        grid = np.empty(rows * block_ids, dtype=np.uint32)
        grid[:len(part)] = part
        if len(part) < len(grid):
            grid[len(part):] = part[(rows - 1) * block_ids:].min()
        grid = grid.reshape(rows, block_ids)
        low = grid.min(axis=1)
        diff = grid - low[:, None]
        rank = min(block_ids - 1, int(np.ceil(percentile * block_ids)) - 1)
        mark = np.partition(diff, rank, axis=1)[:, rank].astype(np.uint64)
        width = np.zeros(rows, dtype=np.int64)
        for bit in range(32):
            width[mark >> np.uint64(bit) > 0] = bit + 1
        over = (diff.astype(np.uint64) >> width[:, None].astype(np.uint64)) > 0
        kept = np.where(over, np.uint32(0), diff)
        packed: list[bytes] = [b""] * rows
        for w in np.unique(width):
            if w == 0:
                continue
            which = np.nonzero(width == w)[0]
            for r, row in zip(which, _pack(kept[which], int(w))):
                packed[r] = row.tobytes()
        for r in range(rows):
            pos = np.nonzero(over[r])[0]
            blob = (_BLOCK.pack(int(low[r]), int(width[r]), len(pos)) + packed[r] + pos.astype("<u2").tobytes()
                    + diff[r, pos].astype("<u4").tobytes())
            starts[b0 + r] = at
            at += len(blob)
            body.append(blob)
    starts[blocks] = at
    return b"".join(body), starts


def _pack(values, width: int):
    """Rows of numbers packed at ``width`` bits each, lowest bit first: 64 numbers make ``width`` 64-bit words."""
    import numpy as np
    rows, n = values.shape
    groups = -(-n // 64)
    v = np.zeros((rows, groups * 64), np.uint64)
    v[:, :n] = values
    v = v.reshape(rows, groups, 64)
    words = np.zeros((rows, groups, width + 1), np.uint64)
    for j in range(64):
        at, shift = divmod(j * width, 64)
        words[:, :, at] |= v[:, :, j] << np.uint64(shift)
        if shift + width > 64:
            words[:, :, at + 1] |= v[:, :, j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words[:, :, :width]).reshape(rows, -1).astype("<u8").view(np.uint8)[:, :(n * width + 7) // 8]


def _unpack(raw, width: int, n: int):
    """The ``n`` numbers of every row of ``_pack``."""
    import numpy as np
    rows, groups = len(raw), -(-n // 64)
    data = np.zeros((rows, groups * width * 8), np.uint8)
    data[:, :raw.shape[1]] = raw
    words = data.view("<u8").reshape(rows, groups, width)
    out = np.empty((rows, groups, 64), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        at, shift = divmod(j * width, 64)
        value = words[:, :, at] >> np.uint64(shift)
        if shift + width > 64:
            value = value | words[:, :, at + 1] << np.uint64(64 - shift)
        out[:, :, j] = value & mask
    return out.reshape(rows, -1)[:, :n]


def unpack_blocks(body, starts, n: int, block_ids: int = BLOCK_IDS, first: int = 0, last: int | None = None):
    """Ids of the blocks from ``first`` up to ``last`` (all by default), cut at ``n`` ids."""
    import numpy as np
    blocks = len(starts) - 1
    last = blocks if last is None else min(last, blocks)
    if last <= first:
        return np.empty(0, dtype=np.uint32)
    out = np.zeros((last - first, block_ids), dtype=np.uint32)
    low = np.empty(last - first, dtype=np.uint32)
    width = np.empty(last - first, dtype=np.int64)
    wrong = []
    for i in range(first, last):
        at = int(starts[i])
        low[i - first], width[i - first], count = _BLOCK.unpack_from(body, at)
        if count:
            wrong.append((i - first, at + _BLOCK.size + (block_ids * int(width[i - first]) + 7) // 8, count))
    for w in np.unique(width):
        if w == 0:
            continue
        which = np.nonzero(width == w)[0]
        size = (block_ids * int(w) + 7) // 8
        for c0 in range(0, len(which), 256):
            some = which[c0:c0 + 256]
            raw = np.stack([np.frombuffer(body, np.uint8, size, int(starts[first + i]) + _BLOCK.size) for i in some])
            out[some] = _unpack(raw, int(w), block_ids)
    for i, at, count in wrong:
        pos = np.frombuffer(body, "<u2", count, at)
        out[i, pos] = np.frombuffer(body, "<u4", count, at + 2 * count)
    out += low[:, None]
    return out.reshape(-1)[:max(0, n - first * block_ids)]


def write_shard(doc_ids: list, counts: list[int], ids, block_ids: int = BLOCK_IDS) -> bytes:
    """One shard file's bytes; a null doc_id is kept as null."""
    import numpy as np
    body, starts = pack_blocks(ids, block_ids)
    return b"".join([
        _HEAD.pack(b"PFR1", block_ids, len(doc_ids), len(ids), len(starts) - 1),
        np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
        np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes(),
        np.array(counts, dtype="<u8").tobytes(), starts.tobytes(), body])


def read_shard(data: bytes):
    """(doc ids with None for null, counts, ids) of a shard file."""
    import numpy as np
    magic, block_ids, n_docs, n_ids, n_blocks = _HEAD.unpack_from(data, 0)
    if magic != b"PFR1":
        raise ValueError("not a token shard")
    at = _HEAD.size
    docs = np.frombuffer(data, "<i8", n_docs, at)
    at += 8 * n_docs
    null = np.frombuffer(data, np.uint8, n_docs, at)
    at += n_docs
    counts = np.frombuffer(data, "<u8", n_docs, at).astype(np.int64)
    at += 8 * n_docs
    starts = np.frombuffer(data, "<u8", n_blocks + 1, at)
    at += 8 * (n_blocks + 1)
    ids = unpack_blocks(memoryview(data)[at:], starts, n_ids, block_ids)
    return [None if x else int(d) for d, x in zip(docs, null)], counts, ids


_ENCODERS: dict[tuple[str, str], TextEncoder] = {}


def text_encoder(path: str, pattern: str) -> TextEncoder:
    """The tokenizers library's BPE model behind the piece caches.

    ``pattern`` cuts pre-tokens as the file's byte-level pre-tokeniser does, the model merges them. Added
    tokens' strings are ordinary text here; ``file_encoder`` matches them.
    """
    if (path, pattern) not in _ENCODERS:
        import json
        from array import array

        from tokenizers import Tokenizer

        from .bpe import byte_chars
        tokenizer = Tokenizer.from_file(path)
        step = json.loads(tokenizer.to_str())
        if (step["pre_tokenizer"] or {}).get("type") != "ByteLevel" or step["normalizer"]:
            raise ValueError("a byte-level vocabulary without normaliser is expected")
        merge, chars = tokenizer.model.tokenize, dict(enumerate(byte_chars()))

        def word(w: str) -> bytes:
            return array("I", [t.id for t in merge(w.encode().decode("latin-1").translate(chars))]).tobytes()

        _ENCODERS[path, pattern] = TextEncoder(pattern, word)
    return _ENCODERS[path, pattern]


_FILE_ENCODERS: dict[tuple[str, str], object] = {}


def file_encoder(path: str, pattern: str):
    """Ids of whole texts as the tokenizers library gives them with add_special_tokens=False.

    Texts are cut at the file's added tokens, each of which is one id; what lies between goes through
    ``text_encoder``. Added tokens that take more than their own characters are left to the library.
    """
    if (path, pattern) not in _FILE_ENCODERS:
        import re
        from array import array

        from tokenizers import Tokenizer
        tokenizer, plain = Tokenizer.from_file(path), text_encoder(path, pattern)
        added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        bare = not any(t.lstrip or t.rstrip or t.single_word for t in tokenizer.get_added_tokens_decoder().values())
        cut = re.compile("|".join(re.escape(a) for a in sorted(added, key=len, reverse=True))) if added else None
        one = {a: array("I", [i]).tobytes() for a, i in added.items()}

        def split(text: str) -> bytes:
            if not bare:
                return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            parts, at = [], 0
            for m in cut.finditer(text):
                parts += (text[at:m.start()], m.group())
                at = m.end()
            parts.append(text[at:])
            ids = plain(parts[::2])
            return b"".join(x for i, p in enumerate(ids) for x in (p, one[parts[2 * i + 1]] if 2 * i + 1 < len(parts) else b""))

        def encode(texts: list[str]) -> list[bytes]:
            if cut is None:
                return plain(texts)
            holds = [any(a in t for a in added) for t in texts]
            ids = iter(plain([t for t, h in zip(texts, holds) if not h]))
            return [split(t) if h else next(ids) for t, h in zip(texts, holds)]

        _FILE_ENCODERS[path, pattern] = encode
    return _FILE_ENCODERS[path, pattern]


def write_token_files(docs: DataFrame, vocabulary: str, pattern: str, path: str | None = None, end_id: int = END_ID,
                      shard_ids: int = SHARD_IDS) -> tuple[str, DataFrame]:
    """Encode ``documents`` into shard files below ``path`` in ascending doc_id order; added tokens in a text are matched.

    Returns the folder and the manifest (file, part, seq, n_docs, n_ids, start, first_doc).
    Rows with a null doc_id come first, repeated doc_ids in the order of their texts; a null
    text is a document of the end id alone. Texts are range-partitioned by doc_id, encoded
    inside their partition and streamed into shards, so a task holds one shard at a time.
    Every attempt writes files of its own; only a finished task's names reach the manifest.
    """
    spark = docs.sparkSession
    ship(spark)
    path = path or shared_path(spark, "tokens")

    def run(it: Iterator) -> Iterator:
        import uuid

        import pyarrow as pa
        import pyarrow.fs as pfs
        from pyspark import TaskContext
        fs, base = pfs.FileSystem.from_uri(path)
        part = TaskContext.get().partitionId()
        attempt = uuid.uuid4().hex[:12]
        encode = file_encoder(vocabulary, pattern)
        end = struct.pack("<I", end_id)
        names, rows = ["file", "part", "seq", "n_docs", "n_ids"], []
        doc_ids, counts, chunks, held = [], [], [], 0

        def close():
            nonlocal doc_ids, counts, chunks, held
            import numpy as np
            name = f"shard-{part:06d}-{len(rows):06d}-{attempt}.pfor"
            fs.create_dir(base, recursive=True)
            with fs.open_output_stream(f"{base}/{name}") as out:
                out.write(write_shard(doc_ids, counts, np.frombuffer(b"".join(chunks), dtype="<u4")))
            rows.append((name, part, len(rows), len(doc_ids), held))
            doc_ids, counts, chunks, held = [], [], [], 0

        for batch in batches_by_bytes(it, "text", 4 << 20):
            for d, x in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()])):
                doc_ids.append(d)
                counts.append(len(x) // 4 + 1)
                chunks += (x, end)
                held += counts[-1]
                if held >= shard_ids:
                    close()
        if doc_ids:
            close()
        if rows:
            yield pa.record_batch([pa.array([r[i] for r in rows]) for i in range(5)], names=names)

    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    shards = (source.repartitionByRange(F.col("doc_id").asc_nulls_first())
              .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
              .mapInArrow(run, "file string, part long, seq long, n_docs long, n_ids long"))
    shards.write.parquet(f"{path}/_shards")
    # One row per shard file of millions of ids: a running sum over them is a small single task.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    manifest = (spark.read.parquet(f"{path}/_shards")
                .withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
                .withColumn("first_doc", F.coalesce(F.sum("n_docs").over(before), F.lit(0))))
    manifest.write.parquet(f"{path}/_manifest")
    return path, spark.read.parquet(f"{path}/_manifest")


def read_token_files(manifest: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Documents back from the shard files of a manifest: doc_id, start, n_tokens, ids_crc32 (and ids).

    ``start`` counts all ids before the document over all shards; ids include the end id.
    One task reads whole shards, one after the other.
    """
    spark = manifest.sparkSession
    ship(spark)

    def run(it: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.fs as pfs
        fs, base = pfs.FileSystem.from_uri(path)
        for batch in it:
            for row in batch.to_pylist():
                with fs.open_input_stream(f"{base}/{row['file']}") as f:
                    doc_ids, counts, ids = read_shard(f.read())
                ids = ids.astype("<u4")
                ends = np.cumsum(counts)
                begins = ends - counts
                raw = memoryview(ids.tobytes())
                cols = [pa.array(doc_ids, pa.int64()), pa.array(begins + row["start"], pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array([zlib.crc32(raw[4 * b:4 * e]) for b, e in zip(begins.tolist(), ends.tolist())],
                                 pa.int64()),
                        pa.array([row["file"]] * len(doc_ids))]
                names = ["doc_id", "start", "n_tokens", "ids_crc32", "file"]
                if with_ids:
                    cols.append(pa.array([ids[b:e].astype(np.int32) for b, e in zip(begins, ends)],
                                         pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.record_batch(cols, names=names)

    files = manifest.count()
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, file string" + ", ids array<int>" * with_ids
    spread = manifest.select("file", "start").repartition(max(1, min(files, 4 * spark.sparkContext.defaultParallelism)))
    return spread.mapInArrow(run, schema)


def token_digest(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Write the token files of ``docs`` and return what they hold, per document."""
    path, manifest = write_token_files(docs, vocabulary, pattern)
    return read_token_files(manifest, path)
