"""Preference formatting: one rendered prompt and two masked completions per conversation pair.

The chosen and the rejected conversation of a pair are compared turn by turn. The longest
common prefix of turns is rendered once, as the prompt; what follows on either side is a
completion in which only assistant turns carry the loss mask. The result has one row per
rendered turn with its place in the part's text, so no conversation is ever gathered into
one row: turn positions and text offsets are running sums in two levels, inside blocks of
turns and over the blocks.

Turns are ordered by turn, role, text, nulls first. Null text is empty, a null role is
"unknown", and rows with a null pair are left out. Repeated rows are turns of their
own. Identical conversations are all prompt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, materialize

#: Turns whose turn numbers fall into one block are numbered by one window.
BLOCK_TURNS = 256


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def _running(df: DataFrame, keys: list[str], block: Column, order: list, amount: Column, name: str) -> DataFrame:
    """Sum of ``amount`` over the rows before each row of its keys, over blocks first."""
    d = df.withColumns({"_block": block, "_amount": amount})
    sums = d.groupBy(*keys, "_block").agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (d.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
            .join(offsets, [*keys, "_block"])
            .withColumn(name, F.col("_offset") + F.col("_inside"))
            .drop("_block", "_amount", "_sum", "_offset", "_inside"))


def positions(turns: DataFrame) -> DataFrame:
    """pair_id, pos (0, 1, ...), role, text of turns (pair_id, turn, role, text)."""
    t = turns.where("pair_id is not null").select(
        "pair_id", F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 40))).alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    out = _running(t, ["pair_id"], F.floor(F.col("turn") / BLOCK_TURNS).cast("long"), ["turn", "role", "text"],
                   F.lit(1).cast("long"), "pos")
    return out.select("pair_id", "pos", "role", "text")


def _facts(turns: DataFrame, side: int) -> DataFrame:
    """What decides about a turn, without its text: pair_id, pos, side, role, digest and length of what is rendered."""
    shown = render(F.col("role"), F.col("text"))
    return turns.select("pair_id", "pos", F.lit(side).alias("side"), "role", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("digest"),
                        F.length(shown).cast("long").alias("length"))


def _block(pos: str = "pos") -> Column:
    return F.floor(F.col(pos) / BLOCK_TURNS)


def preference_rows(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rendered turns of every pair: pair_id, part, pos, role, rendered, start, end, mask.

    ``chosen`` and ``rejected`` are (pair_id, pos, role, text) as ``positions`` returns them, best as stored tables. part is
    prompt, chosen or rejected; start and end count code points in the part's whole text; mask is 1
    where the loss counts. Parts and places are found on digests and lengths; each shown text is shuffled
    once, to its place, so a conversation of any number of turns is spread over all tasks.
    """
    facts = checkpoint(_facts(chosen, 0).union(_facts(rejected, 1)))
    # A position differs if it does not have two equal turns; the first such position ends the prompt.
    same = facts.groupBy("pair_id", "pos").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("lo"), F.max("digest").alias("hi"))
    cut = same.groupBy("pair_id").agg(F.coalesce(
        F.min(F.when((F.col("n") < 2) | (F.col("lo") != F.col("hi")), F.col("pos"))), F.max("pos") + 1).alias("cut"))
    blocks = facts.select("pair_id", _block().alias("_b")).distinct().join(cut, "pair_id")
    parts = (facts.withColumn("_b", _block()).join(blocks, ["pair_id", "_b"]).where("side = 0 or pos >= cut")
             .select("pair_id", F.when(F.col("pos") < F.col("cut"), "prompt").when(F.col("side") == 0, "chosen")
                     .otherwise("rejected").alias("part"), "pos", "side", "length"))
    placed = _running(parts, ["pair_id", "part"], _block(), ["pos"], F.col("length"), "start")
    texts = (chosen.select("pair_id", "pos", F.lit(0).alias("side"), "role", "text")
             .union(rejected.select("pair_id", "pos", F.lit(1).alias("side"), "role", "text")))
    out = texts.join(placed, ["pair_id", "pos", "side"])
    return out.select("pair_id", "part", "pos", "role", render(F.col("role"), F.col("text")).alias("rendered"), "start",
                      (F.col("start") + F.col("length")).alias("end"),
                      ((F.col("role") == "assistant") & (F.col("part") != "prompt")).cast("int").alias("mask"))


def pairs_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected conversations from a table without preferences, as ``positions`` returns them.

    The whole conversation is chosen. The rejected one is the same, but in the place of its last assistant turn it has that of
    the conversation with the next number, or no turn where there is none. A conversation without an assistant turn
    is rejected as it stands, so it is all prompt. Both tables are stored.
    """
    turns = materialize(positions(conversations.select(F.col("conv_id").cast("long").alias("pair_id"), "turn", "role", "text")), "turns")
    last = turns.where("role = 'assistant'").groupBy("pair_id").agg(
        F.max(F.struct("pos", "text")).alias("l")).select("pair_id", F.col("l.pos").alias("pos"), F.col("l.text").alias("reply"))
    last = checkpoint(last)
    other = last.select((F.col("pair_id") - 1).alias("pair_id"), "reply")
    swapped = (last.select("pair_id", "pos").join(other, "pair_id")
               .select("pair_id", "pos", F.lit("assistant").alias("role"), F.col("reply").alias("text")))
    kept = turns.join(last.select("pair_id", "pos"), ["pair_id", "pos"], "left_anti").select("pair_id", "pos", "role", "text")
    return turns, materialize(kept.union(swapped), "rejected")


ORACLE = """
WITH t AS (SELECT conv_id AS pair_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS pos,
    coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT pair_id, max(pos) AS last, arg_max(text, pos) AS reply FROM t WHERE role = 'assistant' GROUP BY pair_id),
c AS (SELECT * FROM t),
r AS (SELECT t.* FROM t LEFT JOIN l USING (pair_id) WHERE last IS NULL OR pos <> last
      UNION ALL SELECT l.pair_id, l.last, 'assistant', o.reply FROM l JOIN l o ON o.pair_id = l.pair_id + 1),
d AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.pos, r.pos) AS pos,
      c.pair_id IS NOT NULL AND r.pair_id IS NOT NULL AND c.role = r.role AND c.text = r.text AS same
      FROM c FULL JOIN r ON c.pair_id = r.pair_id AND c.pos = r.pos),
u AS (SELECT pair_id, coalesce(min(pos) FILTER (NOT same), max(pos) + 1) AS cut FROM d GROUP BY pair_id),
p AS (SELECT c.*, CASE WHEN pos < cut THEN 'prompt' ELSE 'chosen' END AS part FROM c JOIN u USING (pair_id)
      UNION ALL SELECT r.*, 'rejected' FROM r JOIN u USING (pair_id) WHERE pos >= cut),
f AS (SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered FROM p)
SELECT pair_id, part, pos, role, rendered, (sum(length(rendered)) OVER w - length(rendered))::BIGINT AS start,
  (sum(length(rendered)) OVER w)::BIGINT AS "end", CASE WHEN role = 'assistant' AND part <> 'prompt' THEN 1 ELSE 0 END AS mask
FROM f WINDOW w AS (PARTITION BY pair_id, part ORDER BY pos)
"""
