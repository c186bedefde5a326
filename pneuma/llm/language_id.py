"""Language id with interpolated Kneser-Ney character models in sorted hash arrays.

A text is lower-cased, every run of other characters than letters becomes one boundary
sign, and each character is predicted from the three before it. Counts of four-character
grams are aggregated over all learning documents; lower orders use continuation counts. Per
order the discounted probabilities and the back-off weights stand in tables sorted by the full
64-bit hash of the gram and partitioned by its range. They grow with the corpus; texts meet them
in joins, and neither the driver nor a broadcast holds them.

The language with the lowest cross-entropy per character wins. On calibration documents (not
counted) a temperature for the score and, per language, the largest accepted cross-entropy
are set; ``rejected`` tells that the best language is beyond it.

``und`` with score 0 is returned for null text, text without a letter, and where nothing was
learned. A null doc_id is never learned from. Repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, checkpoint, materialize, ship

ORDER = 4
#: Text of one batch of documents whose distinct grams are looked up together, shared out over the languages beyond four.
BATCH_BYTES = 16 << 20
#: Text that a task takes up at once, and grams (8 bytes each) that it gathers before it names the distinct ones of each batch.
PIECE_BYTES, ASKED_AT_ONCE = 2 << 20, 1 << 20
#: Characters of a text whose grams are made at once.
SLICE_CHARS = 1 << 19
FOLDS = 5
CALIBRATION_FOLD = 1
#: Share of a language's calibration documents that its threshold accepts.
ACCEPT = 0.995
TEMPERATURES = [2.0 ** k for k in range(0, 13)]
_MASK16 = 0xFFFF
_LETTER = None


def _letters():
    """For every code point its 16-bit sign if it is a letter, else 0; code points beyond 16 bits are folded."""
    global _LETTER
    if _LETTER is None:
        import sys

        import numpy as np
        t = np.zeros(sys.maxunicode + 1, dtype=np.uint16)
        for c in range(sys.maxunicode + 1):
            if chr(c).isalpha():
                t[c] = (c & _MASK16) ^ (c >> 16) or 1
        _LETTER = t
    return _LETTER


def gram_parts(text: str | None) -> Iterator:
    """The 64-bit four-character grams of a whole text, one per character or boundary, slice by slice; none without a letter."""
    import numpy as np
    before, after_letter = np.zeros(ORDER - 1, dtype=np.uint64), False
    for begin in range(0, len(text or ""), SLICE_CHARS):
        t = text[begin:begin + SLICE_CHARS].lower()
        sign = _letters()[np.frombuffer(t.encode("utf-32-le", "replace"), dtype=np.uint32)]
        keep = sign != 0
        keep[1:] |= sign[:-1] != 0
        keep[0] |= after_letter
        after_letter = bool(sign[-1])
        body = sign[keep].astype(np.uint64)
        if after_letter and begin + SLICE_CHARS >= len(text):
            body = np.append(body, np.uint64(0))
        s = np.concatenate([before, body])
        before = s[len(s) - ORDER + 1:]
        out = s[ORDER - 1:].copy()
        for k in range(1, ORDER):
            out |= s[ORDER - 1 - k:len(s) - k] << np.uint64(16 * k)
        if len(out):
            yield out


def grams(text: str | None):
    """All grams of a text in one array."""
    import numpy as np
    parts = list(gram_parts(text))
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def count_grams(learn: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of ``learn`` (text, lang); summed inside a task before the shuffle."""
    def run(it: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def counted(lang, parts):
            value, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.record_batch([pa.array([lang] * len(value)), pa.array(value.view(np.int64)), pa.array(n, pa.int64())],
                                   names=["lang", "gram", "n"])

        held: dict[str, list] = {}
        size = 0
        for batch in batches_by_bytes(it, "text", PIECE_BYTES):
            for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for g in gram_parts(t):
                    held.setdefault(lang, []).append(g)
                    size += len(g)
                    if size > ASKED_AT_ONCE:
                        yield from (counted(x, parts) for x, parts in held.items())
                        held, size = {}, 0
        yield from (counted(x, parts) for x, parts in held.items())

    return (learn.select("text", "lang").mapInArrow(run, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


class Model:
    """The tables of ``build`` (null where nothing was learned), with the calibration."""

    def __init__(self, langs: list[str], tables: DataFrame | None):
        self.langs, self.tables = langs, tables
        self.temperature = 1.0
        self.limit: dict[str, float] = {}

    def vectors(self, wanted: DataFrame) -> DataFrame:
        """gram and ``p``, the natural log probabilities of its last character per language, for distinct ``gram``.

        Orders go upwards over the distinct grams of each order, so a table entry meets at most one row per letter.
        """
        def look(n: int, what: str, key: str) -> DataFrame:
            return self.tables.where((F.col("o") == n) & (F.col("what") == what)).select(F.col("h").alias(key), F.col("v").alias(what))

        below = None
        for n in range(1, ORDER + 1):
            x = wanted.select("gram") if n == ORDER else wanted.select(_masked("gram", n).alias("gram")).distinct()
            x = x.select("gram", F.xxhash64("gram").alias("hg"), F.xxhash64(F.shiftrightunsigned("gram", 16)).alias("hc"),
                         _masked("gram", n - 1).alias("low"))
            contexts = look(n, "context", "hc")
            x = x.join(look(n, "gram_v", "hg"), "hg", "left").join(F.broadcast(contexts) if n == 1 else contexts, "hc", "left")
            if below is None:
                x = x.withColumn("p", F.array_repeat(F.lit(1.0 / 65536), len(self.langs)))
            else:
                x = x.join(below, "low")
            part = F.when(F.col("context").isNull(), F.col("p")).otherwise(
                F.zip_with("context", "p", lambda c, q: F.coalesce(c, F.lit(1.0)) * q))
            both = F.when(F.col("gram_v").isNull(), part).otherwise(
                F.zip_with("gram_v", part, lambda v, q: F.coalesce(v, F.lit(0.0)) + q))
            below = x.select(F.col("gram").alias("low"), both.alias("p"))
        return below.select(F.col("low").alias("gram"), F.transform("p", lambda q: F.log(F.greatest(q, F.lit(1e-30)))).alias("p"))

    def log_probs(self, gram):
        """Natural log probability of each gram's last character, per language (rows)."""
        import numpy as np
        keys = np.asarray(gram, dtype=np.uint64).view(np.int64).tolist()
        asked = self.tables.sparkSession.createDataFrame([(k,) for k in set(keys)], "gram long")
        found = {r["gram"]: r["p"] for r in self.vectors(asked).collect()}
        return np.array([found[k] for k in keys]).T


def _masked(gram: str, n: int) -> Column:
    """The last ``n`` characters of a gram."""
    return F.col(gram) if n == ORDER else F.col(gram).bitwiseAND(F.lit((1 << 16 * n) - 1))


def build(counts: DataFrame) -> Model:
    """Kneser-Ney tables from (lang, gram, n): one row (o, what, h, v) per order and distinct gram or context.

    ``h`` is the full 64-bit hash of the name, which no two names of one order share; ``v`` has a value per language,
    null where that language lacks the name. Rows are range-partitioned and sorted by hash.
    """
    now = checkpoint(counts)
    langs = sorted(r["lang"] for r in now.select("lang").distinct().collect())
    if not langs:
        return Model([], None)
    parts = []
    for n in range(ORDER, 0, -1):
        if n < ORDER:
            now = now.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 16 * n) - 1)).alias("gram")).agg(
                F.count(F.lit(1)).alias("n"))
        parts.append(now.select("lang", F.lit(n).alias("o"), "gram",
                                F.shiftrightunsigned(F.col("gram"), 16).alias("ctx"), "n"))
    grams_ = parts[0]
    for p in parts[1:]:
        grams_ = grams_.union(p)
    grams_ = checkpoint(grams_)
    seen = grams_.groupBy("lang", "o").agg(F.sum((F.col("n") == 1).cast("long")).alias("n1"),
                                           F.sum((F.col("n") == 2).cast("long")).alias("n2"))
    discount = seen.select("lang", "o", F.when(F.col("n1") + F.col("n2") == 0, 0.5).otherwise(F.greatest(
        F.lit(0.1), F.least(F.lit(0.9), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))))).alias("d"))
    context = grams_.groupBy("lang", "o", "ctx").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
    context = context.join(F.broadcast(discount), ["lang", "o"])  # one row per language and order
    prob = (grams_.join(context, ["lang", "o", "ctx"])
            .select("lang", "o", F.lit("gram_v").alias("what"), F.xxhash64("gram").alias("h"),
                    (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("v")))
    back = context.select("lang", "o", F.lit("context").alias("what"), F.xxhash64("ctx").alias("h"),
                          (F.col("d") * F.col("types") / F.col("total")).alias("v"))
    tables = prob.union(back).groupBy("o", "what", "h").agg(
        F.array(*[F.max(F.when(F.col("lang") == x, F.col("v"))) for x in langs]).alias("v"))
    return Model(langs, materialize(tables.repartitionByRange("h").sortWithinPartitions("h"), "language-model"))


def _packed(dealt: DataFrame) -> DataFrame:
    """(_batch, rows): the rows of each batch as compressed Arrow tables, which are what is shuffled."""
    def run(it: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
        for batch in batches_by_bytes(it, "text", 4 * PIECE_BYTES):
            number = batch.column(0).to_numpy()
            order = np.argsort(number, kind="stable")
            table = pa.Table.from_batches([batch]).drop_columns(["_batch"]).take(pa.array(order))
            edges = np.r_[np.flatnonzero(np.r_[True, np.diff(number[order]) != 0]), len(order)]
            for a, b in zip(edges, edges[1:]):
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, table.schema, options=options) as w:
                    w.write_table(table.slice(a, b - a).combine_chunks())
                yield pa.record_batch([pa.array([number[order[a]]], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())],
                                      names=["_batch", "rows"])

    return dealt.mapInArrow(run, "_batch long, rows binary")


def _scored(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The kept columns and ``ce``, the cross-entropies in the order of the model's languages (null: no letter).

    Rows are dealt to batches of about ``BATCH_BYTES`` of text by a hash of their columns. A batch's distinct grams meet the
    model in a join, and what they get comes back to the batch.
    """
    kinds = dict(rows.dtypes)
    if not model.langs:
        return rows.select(*keep, F.lit(None).cast("array<double>").alias("ce"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    batches = 1 + size // (4 * BATCH_BYTES // max(4, len(model.langs)))
    dealt = rows.select(F.pmod(F.xxhash64(*keep, "text"), F.lit(batches)).alias("_batch"), "text", *keep)

    def ask(it: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        held: dict[int, list] = {}
        n = 0

        def flush():
            for b, parts in held.items():
                every = np.unique(np.concatenate(parts))
                yield pa.record_batch([pa.array(np.full(len(every), b)), pa.array(every.view(np.int64))], names=["_b", "gram"])

        for batch in batches_by_bytes(it, "text", PIECE_BYTES):
            for b, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for g in gram_parts(t):
                    held.setdefault(b, []).append(np.unique(g))
                    n += len(held[b][-1])
                    if n > ASKED_AT_ONCE:
                        yield from flush()
                        held, n = {}, 0
        yield from flush()

    def score(mine, known):
        import numpy as np
        import pyarrow as pa
        names = known.column("gram").to_numpy().view(np.uint64)
        order = np.argsort(names)
        names = names[order]
        p = known.column("p").combine_chunks().flatten().to_numpy().reshape(len(names), -1)[order] if len(names) else None
        out = []
        for packed in mine.column("rows"):
            table = pa.ipc.open_stream(packed.as_buffer()).read_all()
            ce = []
            for t in table.column("text"):
                total, n = 0.0, 0
                for g in gram_parts(t.as_py()):
                    total, n = total - p[np.searchsorted(names, g)].sum(axis=0), n + len(g)
                ce.append(total / n if n else None)
            out.append(pa.table({**{k: table.column(k) for k in keep}, "ce": pa.array(ce, pa.list_(pa.float64()))}))
        return pa.concat_tables(out) if out else pa.table({**{k: pa.array([], pa.null()) for k in keep}, "ce": pa.array([], pa.list_(pa.float64()))})

    asked = checkpoint(dealt.select("_batch", "text").mapInArrow(ask, "_b long, gram long").distinct())
    known = asked.join(model.vectors(asked.select("gram").distinct()), "gram")
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keep), "ce array<double>"])
    return _packed(dealt).groupBy("_batch").cogroup(known.groupBy("_b")).applyInArrow(score, schema)


def calibrate(model: Model, rows: DataFrame) -> None:
    """Set the temperature (least negative log likelihood of the true language) and the accepted cross-entropies."""
    if not model.langs:
        return
    names = F.array(*(F.lit(x) for x in model.langs))
    s = (_scored(rows, model, ["doc_id", "lang"]).where("ce is not null")
         .withColumn("own", F.get("ce", F.array_position(names, F.col("lang")).cast("int") - 1)).where("own is not null"))
    best = F.array_min("ce")

    def loss(t: float) -> Column:
        z = F.aggregate("ce", F.lit(0.0), lambda a, x: a + F.exp(-t * (x - best)))
        return F.sum(t * (F.col("own") - best) + F.log(z))

    s = checkpoint(s)
    row = s.agg(*(loss(t).alias(f"t{i}") for i, t in enumerate(TEMPERATURES))).first()
    if row["t0"] is not None:
        model.temperature = min(zip([row[f"t{i}"] for i in range(len(TEMPERATURES))], TEMPERATURES))[1]
    for r in s.groupBy("lang").agg(F.percentile_approx("own", ACCEPT, 10_000).alias("limit")).collect():
        model.limit[r["lang"]] = r["limit"]


def learn(docs: DataFrame) -> Model:
    """A calibrated model from the rows whose fold is not 0 and whose lang is not null; all of them are read."""
    ship(docs.sparkSession)
    usable = docs.where(docs["lang"].isNotNull() & docs["text"].isNotNull() & (fold(docs["doc_id"]) != 0)).select(
        docs["text"], docs["lang"].cast("string").alias("lang"), docs["doc_id"].cast("long").alias("doc_id"), fold(docs["doc_id"]).alias("f"))
    model = build(count_grams(usable.where(F.col("f") != CALIBRATION_FOLD)))
    calibrate(model, usable.where(F.col("f") == CALIBRATION_FOLD))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected; only text is used for the prediction."""
    ship(docs.sparkSession)
    src = docs.select(docs["text"], docs["doc_id"].cast("long").alias("doc_id"))
    s = _scored(src, model, ["doc_id"])
    names = F.array(*(F.lit(x) for x in model.langs)) if model.langs else F.array().cast("array<string>")
    limits = F.array(*(F.lit(model.limit.get(x, float("inf"))) for x in model.langs)) if model.langs else F.array(
        F.lit(0.0))
    best = F.array_min("ce")
    at = F.array_position("ce", best).cast("int") - 1
    z = F.aggregate("ce", F.lit(0.0), lambda a, x: a + F.exp(-model.temperature * (x - best)))
    return s.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"),
        F.when(F.col("ce").isNull(), "und").otherwise(F.get(names, at)).alias("lang_pred"),
        F.when(F.col("ce").isNull(), 0.0).otherwise(1 / z).alias("score"),
        best.alias("cross_entropy"),
        F.coalesce(best > F.get(limits, at), F.lit(True)).alias("rejected"))
