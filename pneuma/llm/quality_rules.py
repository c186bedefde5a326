"""Quality rules: text statistics, and a decision list learned from labelled statistics.

``text_stats`` counts over every whole text. ``learn_rules`` grows one threshold conjunction after
the other by sequential covering (information gain on a grow set), prunes each on a
held-out prune set, and stops when a rule is no better than chance there. The list is
emitted as one ordered Spark conditional expression, so applying it is a projection.

Null text has no words: all counts are zero and the base rules reject it. Repeated rows
each get a row; several labels of one document count as low quality if any says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, checkpoint, ship

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
STAT_SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars long, "
               "n_lines long, n_upper long, n_distinct_words long, n_end_marks long, n_digits long")

#: Features of the rules: name -> expression over the statistics; ratios are 0 for an empty denominator.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word_chars": "coalesce(word_chars / nullif(n_words, 0), 0)",
    "symbol_ratio": "coalesce(n_symbols / nullif(n_words, 0), 0)",
    "dup_line_ratio": "coalesce(n_dup_lines / nullif(n_lines, 0), 0)",
    "repeat_ratio": "coalesce(n_repeat_words / nullif(n_words, 0), 0)",
    "upper_ratio": "coalesce(n_upper / nullif(word_chars, 0), 0)",
    "distinct_ratio": "coalesce(n_distinct_words / nullif(n_words, 0), 0)",
    "end_mark_ratio": "coalesce(n_end_marks / nullif(n_words, 0), 0)",
    "digit_ratio": "coalesce(n_digits / nullif(word_chars, 0), 0)",
}

#: Bound on the labelled rows that the learner gathers on the driver (numbers only).
MAX_LABELLED = 20_000


def _repeat_words(codes, window: int) -> int:
    """Words in windows of ``window`` words that are found at least twice, the first included."""
    import numpy as np
    import pandas as pd
    n = len(codes) - window + 1
    if n < 2:
        return 0
    # Windows are named exactly, not by a hash: pairs of names become new names, up to the length.
    key, have = codes.astype(np.int64), 1
    while have < window:
        step = min(have, window - have)
        left, right = key[:len(key) - step], key[step:]
        key = pd.factorize(left * (int(key.max()) + 1) + right)[0]
        have += step
    again = np.bincount(key)[key] > 1
    if not again.any():
        return 0
    mark = np.zeros(len(codes) + 1, dtype=np.int64)
    at = np.nonzero(again)[0]
    np.add.at(mark, at, 1)
    np.add.at(mark, at + window, -1)
    return int((np.cumsum(mark)[:-1] > 0).sum())


def count_text(text: str | None) -> tuple:
    """The statistics of one whole text, in the order of STAT_SCHEMA."""
    import pandas as pd
    t = text or ""
    raw = t.encode()
    words = raw.split()  # bytes split on exactly the ASCII white space of the contract
    n = len(words)
    chars = len(t)
    space = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    if n:
        codes, distinct = pd.factorize(_as_objects(words))
        repeat, n_distinct = _repeat_words(codes, WINDOW), len(distinct)
    else:
        repeat = n_distinct = 0
    return (n, chars - space, sum(raw.count(c.encode()) for c in SYMBOLS), len(lines) - len(set(lines)), repeat, chars,
            len(lines), sum(map(str.isupper, t)) if not t.islower() else 0, n_distinct,
            raw.count(b".") + raw.count(b"!") + raw.count(b"?"),
            sum(raw.count(b"%d" % d) for d in range(10)))


def _as_objects(words: list):
    import numpy as np
    out = np.empty(len(words), dtype=object)
    out[:] = words
    return out


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics, one row per row of ``docs``; a projection without a shuffle."""
    ship(docs.sparkSession)

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa
        names = ["doc_id", *(x.split()[0] for x in STAT_SCHEMA.split(", "))]
        for batch in batches_by_bytes(it, "text", 4 << 20):
            rows = [count_text(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(
        run, f"doc_id long, {STAT_SCHEMA}")


def _unused(columns: list[str], name: str) -> str:
    while name in columns:
        name = "_" + name
    return name


def with_stats(docs: DataFrame) -> DataFrame:
    """(row, statistics): the whole row of ``docs`` as a struct beside its counts, in one pass."""
    ship(docs.sparkSession)
    place, name = docs.columns.index("text"), _unused(docs.columns, "quality_stats")
    names = [x.split()[0] for x in STAT_SCHEMA.split(", ")]

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches_by_bytes(it, "text", 4 << 20):
            cols = list(zip(*(count_text(t) for t in batch.column(place).to_pylist())))
            stats = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names)
            yield pa.record_batch([*batch.columns, stats], names=[*batch.schema.names, name])

    fields = ",".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    stats = ",".join(f"{n}: long" for n in names)
    out = docs.mapInArrow(run, f"{fields},`{name}` struct<{stats}>")
    return out.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), f"{name}.*")


def filter_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` that the base rules and the learned list keep, with all their columns."""
    rules = learn(checkpoint(text_stats(docs)), labels, max_rows)
    return with_stats(docs).where(verdict(rules) == -1).select("row.*")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, "<=" or ">", threshold) that names low-quality text."""

    conditions: tuple[tuple[str, str, float], ...]
    low: int
    covered: int

    def text(self) -> str:
        return " and ".join(f"{f} {op} {t:.6g}" for f, op, t in self.conditions)

    def column(self) -> Column:
        out = F.lit(True)
        for f, op, t in self.conditions:
            c = F.expr(FEATURES[f])
            out = out & (c <= F.lit(t) if op == "<=" else c > F.lit(t))
        return out


def labelled(stats: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> tuple:
    """(feature matrix, low-quality flags, grow flags) of about ``max_rows`` labelled documents, or of all if there are fewer.

    The sample is the documents whose id's hash is below a bound set from their number; only the sample's numbers
    reach the driver.
    """
    import numpy as np
    lab = (labels.where("doc_id is not null and quality is not null")
           .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")))
    one = stats.where(~base_failed()).dropDuplicates(["doc_id"])
    both = checkpoint(one.join(lab, "doc_id").select(
        F.xxhash64("doc_id").alias("h"), "doc_id", (F.col("quality") < 1).alias("low"),
        *(F.expr(e).alias(n) for n, e in FEATURES.items())))
    n = both.count()
    if n > max_rows:
        both = both.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    rows = both.toPandas().sort_values(["h", "doc_id"])
    x = rows[list(FEATURES)].to_numpy(dtype=float).reshape(len(rows), len(FEATURES))
    return x, rows["low"].to_numpy(dtype=bool), (rows["h"].to_numpy() % 3 != 0 if len(rows) else np.zeros(0, bool))


def _best_condition(x, y, covered, n_cuts: int):
    """The condition with the highest information gain over the covered rows, or None."""
    import numpy as np
    p0, n0 = y[covered].sum(), (~y[covered]).sum()
    if p0 == 0 or n0 == 0:
        return None
    base = np.log2(p0 / (p0 + n0))
    best = None
    for j, name in enumerate(FEATURES):
        v = x[covered, j]
        cuts = np.unique(np.quantile(v[y[covered]], np.linspace(0, 1, n_cuts)))
        cuts = np.unique(np.concatenate([cuts, np.quantile(v, np.linspace(0, 1, n_cuts))]))
        for op in ("<=", ">"):
            hit = v[None, :] <= cuts[:, None] if op == "<=" else v[None, :] > cuts[:, None]
            p = (hit & y[covered][None, :]).sum(axis=1)
            n = hit.sum(axis=1) - p
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / np.maximum(p + n, 1)) - base), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0] + 1e-12):
                best = (float(gain[k]), (name, op, float(cuts[k])), j, op, cuts[k])
    return best


def _holds(x, conditions):
    import numpy as np
    out = np.ones(len(x), dtype=bool)
    names = list(FEATURES)
    for f, op, t in conditions:
        v = x[:, names.index(f)]
        out &= v <= t if op == "<=" else v > t
    return out


def learn_rules(x, y, grow, max_rules: int = 12, max_conditions: int = 4, n_cuts: int = 24,
                min_precision: float = 0.9, min_covered: int = 3) -> list[Rule]:
    """Sequential covering: each rule is grown on the grow rows, pruned on the others, and its rows go.

    A rule stays if, after pruning, at least ``min_precision`` of what it covers is low quality on
    both sets together and it covers ``min_covered`` rows; the first that fails ends the list.
    """
    import numpy as np
    rules: list[Rule] = []
    left = np.ones(len(y), dtype=bool)
    while len(rules) < max_rules and (left & grow & y).any():
        conditions: list[tuple[str, str, float]] = []
        covered = left & grow
        while len(conditions) < max_conditions:
            best = _best_condition(x, y, covered, n_cuts)
            if best is None:
                break
            conditions.append(best[1])
            covered &= _holds(x, [best[1]])
        if not conditions:
            break

        def worth(k: int) -> float:
            hit = _holds(x, conditions[:k]) & left & ~grow
            p, n = int((hit & y).sum()), int((hit & ~y).sum())
            return (p - n) / (p + n) if p + n else -1.0

        keep = max(range(1, len(conditions) + 1), key=lambda k: (worth(k), -k))
        chosen = conditions[:keep]
        hit = _holds(x, chosen) & left
        low, all_ = int((hit & y).sum()), int(hit.sum())
        if all_ < min_covered or low < min_precision * all_:
            break
        rules.append(Rule(tuple(chosen), low, all_))
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """0 for a base failure, else the number of the first rule that holds, else -1: kept."""
    out = F.when(base_failed(), F.lit(0))
    for i, r in enumerate(rules, 1):
        out = out.when(r.column(), F.lit(i))
    return out.otherwise(F.lit(-1))


def learn(stats: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> list[Rule]:
    return learn_rules(*labelled(stats, labels, max_rows))


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """The statistics with base_failed, rule (number of the rule that rejected, -1: none) and kept."""
    return stats.withColumns({"base_failed": base_failed(), "rule": verdict(rules)}).withColumn(
        "kept", F.col("rule") == -1)
