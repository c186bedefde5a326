"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Base candidates are the matches of three fixed patterns. Opaque tokens (long, with digits,
lower and upper case, outside base matches) are further candidates. Every candidate
value is hashed and its distinct owners and repositories are counted over the whole corpus: a value
that many owners carry is a copied example, a value of few owners that looks random
is live. Base spans always stay; opaque tokens become spans only when they are live.

Null text is empty. A null owner counts as one owner of its own. Repeated rows each get a
row and count once per distinct repository. Positions are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Fixed patterns of the base kinds; matches are leftmost and do not overlap within a kind.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Smallest lengths: of group 2 for assign, of the whole match for the others.
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
#: A maximal run of one class has the base pattern's match if it is long enough, so the length can stand in the pattern.
ACCESS_LONG = r"AKIA[A-Z0-9]{14,}"
HEX_LONG = r"[0-9a-f]{16,}"
OPAQUE = r"[A-Za-z0-9+/_-]{24,}"
OPAQUE_HINT = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{24,}"
ASSIGN_HINT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
KINDS = ["assign", "access", "hex", "opaque"]
MAX_OWNERS = 2
_BLOCK = 128


def _lengths(parts: Column) -> Column:
    return F.transform(parts, lambda x: F.length(x))


def _raw(kind: str, pattern: str, group: int, hint: Column) -> list[Column]:
    """Gap lengths, match lengths and values of all matches; null where the hint fails."""
    p = F.lit(pattern)
    text = F.col("text")
    return [F.when(hint, _lengths(F.split(text, pattern, -1))).alias(f"{kind}_gaps"),
            F.when(hint, _lengths(F.regexp_extract_all(text, p, F.lit(0)))).alias(f"{kind}_lens"),
            F.when(hint, F.regexp_extract_all(text, p, F.lit(group))).alias(f"{kind}_values")]


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, owner, repo, key (of the row) and the raw matches of each kind.

    One pass over the texts; texts without a kind's hint run no further pattern.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[owner].cast("string").alias("owner"),
                      docs[repository].cast("string").alias("repo"), docs["text"]).withColumn("text", text)
    raw = src.select(
        "doc_id", "owner", "repo", F.md5("text").alias("text_md5"),
        *_raw("assign", ASSIGN, 2, F.col("text").rlike(ASSIGN_HINT)),
        *_raw("access", ACCESS_LONG, 0, F.col("text").contains("AKIA")),
        *_raw("hex", HEX_LONG, 0, F.col("text").rlike(HEX_LONG)),
        *_raw("opaque", OPAQUE, 0, F.col("text").rlike(OPAQUE_HINT)))
    return materialize(raw, "secrets")


def _spans(kind: str) -> Column:
    """Array of (start, end, kind number, hash, live) from the raw columns.

    The start of match i is the sum of all gaps up to it and all matches before it, summed
    over whole blocks first, so a text with very many matches stays linear.
    """
    gaps, lens, values = (F.col(f"{kind}_{x}") for x in ("gaps", "lens", "values"))
    zero = F.lit(0).cast("long")

    def total(a: Column) -> Column:
        return F.aggregate(a, zero, lambda s, x: s + x)

    blocks = F.col(f"{kind}_blocks")

    def one(value: Column, i: Column) -> Column:
        b = F.floor(i / _BLOCK).cast("int")
        start = (total(F.slice(blocks, F.lit(1), b))
                 + total(F.slice(gaps, b * _BLOCK + 1, i - b * _BLOCK + 1))
                 + total(F.slice(lens, b * _BLOCK + 1, i - b * _BLOCK)))
        return F.struct(start.alias("start"), (start + F.get(lens, i)).alias("end"),
                        F.lit(KINDS.index(kind)).alias("kind"), F.sha2(value, 256).alias("hash"),
                        looks_live(value).alias("random"))

    out = F.transform(values, one)
    if kind == "assign":
        out = F.filter(F.arrays_zip(out.alias("s"), values.alias("v")), lambda z: F.length(z["v"]) >= MIN_ASSIGN)
        out = F.transform(out, lambda z: z["s"])
    if kind == "opaque":
        out = F.filter(out, lambda s: s["random"])
    return F.coalesce(out, F.array().cast("array<struct<start:bigint,end:bigint,kind:int,hash:string,random:boolean>>"))


def _block_sums(kind: str) -> Column:
    gaps, lens = F.col(f"{kind}_gaps"), F.col(f"{kind}_lens")
    n = F.coalesce(F.size(lens), F.lit(0))
    zero = F.lit(0).cast("long")

    def total(a: Column) -> Column:
        return F.aggregate(a, zero, lambda s, x: s + x)

    numbers = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")))
    return F.transform(numbers, lambda b: total(F.slice(gaps, b * _BLOCK + 1, F.lit(_BLOCK)))
                       + total(F.slice(lens, b * _BLOCK + 1, F.lit(_BLOCK))))


def looks_live(value: Column) -> Column:
    """Random-looking: a digit and a letter, at least eight different characters; opaque tokens mix cases as well."""
    distinct = F.size(F.array_distinct(F.split(value, "")))
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (distinct >= 8)
    return mixed


def candidates(raw: DataFrame) -> DataFrame:
    """Rows of ``scan`` that have a candidate: doc_id, owner, repo, text_md5, base spans, opaque spans (outside base)."""
    any_match = None
    for k in KINDS:
        c = F.coalesce(F.size(f"{k}_values"), F.lit(0)) > 0
        any_match = c if any_match is None else any_match | c
    summed = raw.where(any_match).withColumns({f"{k}_blocks": _block_sums(k) for k in KINDS})
    spans = summed.select("doc_id", "owner", "repo", "text_md5", *(_spans(k).alias(k) for k in KINDS))
    mixed = F.filter("opaque", lambda s: ~F.exists(F.concat("assign", "access", "hex"), lambda b: (
        (b["start"] < s["end"]) & (s["start"] < b["end"]))))
    return spans.withColumn("opaque", mixed)


def ownership(cands: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """(hash, owners, repos, verdict) per candidate value over the whole corpus.

    Counted in two steps, (hash, owner, repo) rows first, so a value in a third of all documents
    is combined before it is shuffled to its key.
    """
    every = cands.select("owner", "repo", F.explode(F.concat("assign", "access", "hex", "opaque")).alias("s"))
    one = every.groupBy(F.col("s.hash").alias("hash"), "owner", "repo").agg(F.max("s.random").alias("random"))
    per_owner = one.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.max("random").alias("random"))
    return (per_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"),
                                          F.max("random").alias("random"))
            .select("hash", "owners", "repos",
                    F.when(F.col("owners") > max_owners, "example").when(F.col("random"), "live")
                    .otherwise("weak").alias("verdict")))


def find_secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id",
                 max_owners: int = MAX_OWNERS) -> DataFrame:
    """doc_id, owner, text_md5 and spans, one row per row of ``docs``.

    ``spans`` is an array of (start, end, kind, verdict) in the order of start, then kind: all base
    spans, and the opaque tokens whose value is live.
    """
    raw = scan(docs, owner, repository)
    cands = materialize(candidates(raw), "secret-candidates")
    verdicts = ownership(cands, max_owners)
    keys = ["doc_id", "owner", "repo", "text_md5"]
    # A row's spans are exploded once per distinct row and put together again with their verdicts.
    flat = (cands.dropDuplicates(keys)
            .select(*keys, F.explode(F.concat("assign", "access", "hex", "opaque")).alias("s"))
            .withColumn("hash", F.col("s.hash")))
    judged = flat.join(verdicts, "hash").where((F.col("s.kind") != KINDS.index("opaque")) | (F.col("verdict") == "live"))
    per_row = judged.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
        F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"),
        "verdict", "hash"))).alias("spans"))
    r = per_row.select(*(F.col(k).alias(f"r_{k}") for k in keys), "spans")
    same = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"r_{k}"))
        same = c if same is None else same & c
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,verdict:string,hash:string>>")
    # Either side may look small by its stored size and be many rows with long keys: the join names its way, never a broadcast.
    return raw.select(*keys).join(r.hint("merge"), same, "left").select(*keys, F.coalesce("spans", empty).alias("spans"))


def redact(docs: DataFrame, owner: str = "source", max_owners: int = MAX_OWNERS, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mask``, but for widely copied examples; all columns stay.

    n_chars, where there is one, is that of the new text. Overlapping spans become one. Texts are
    shuffled once, by (doc_id, hash of the text).
    """
    found = find_secrets(docs, owner, max_owners=max_owners)
    spans = (found.select("doc_id", "text_md5", F.filter("spans", lambda s: s["verdict"] != "example").alias("spans"))
             .where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_md5"]))
    # Ends reached so far make overlapping spans into runs: a run begins where no earlier span reaches.
    reach = spans.select(F.col("doc_id").alias("s_id"), F.col("text_md5").alias("s_md5"), F.aggregate(
        "spans", F.array().cast("array<struct<a:bigint,z:bigint>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["z"] > s["start"]), F.concat(
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
            F.array(F.struct(F.get(acc, F.size(acc) - 1)["a"].alias("a"),
                             F.greatest(F.get(acc, F.size(acc) - 1)["z"], s["end"]).alias("z")))))
        .otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("a"), s["end"].alias("z")))))).alias("runs"))
    row = docs.select(F.struct("*").alias("row"), docs["doc_id"].cast("long").alias("doc_id"),
                      F.md5(F.coalesce(docs["text"], F.lit(""))).alias("md5"))
    met = row.join(reach.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("md5") == F.col("s_md5")),
                   "left")
    text, runs = F.col("row.text"), F.col("runs")

    def piece(r: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(runs, i - 1)["z"])
        return F.concat(F.substring(text, before.cast("int") + 1, (r["a"] - before).cast("int")), F.lit(mask))

    end = F.get(runs, F.size(runs) - 1)["z"].cast("int")
    new = F.when(runs.isNull(), text).otherwise(F.concat(
        F.array_join(F.transform(runs, piece), ""), F.substring(text, end + 1, F.length(text))))
    out = []
    for f in docs.schema:
        c = F.col(f"row.`{f.name}`")
        if f.name == "text":
            c = new
        elif f.name == "n_chars":
            c = F.when(runs.isNull(), c).otherwise(F.length(new).cast(f.dataType))
        out.append(c.alias(f.name))
    return met.select(*out)


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``find_secrets``, and the counts by verdict."""
    def count(test) -> Column:
        return F.size(F.filter("spans", test)).cast("long")

    def of_kind(i: int):
        return lambda s: s["kind"] == i

    return found.select(
        "doc_id",
        *(count(of_kind(i)).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])),
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        count(lambda s: s["verdict"] == "live").alias("n_live"),
        count(lambda s: s["verdict"] == "example").alias("n_example"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS owner, source IS NULL AS no_owner, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, owner, no_owner, 0 AS kind, regexp_split_to_array(t, p) AS g, regexp_extract_all(t, p, 0) AS f, regexp_extract_all(t, p, 2) AS v
  FROM d, (SELECT '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)' AS p)
  UNION ALL
  SELECT doc_id, owner, no_owner, 1, regexp_split_to_array(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL
  SELECT doc_id, owner, no_owner, 2, regexp_split_to_array(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+') FROM d
  UNION ALL
  SELECT doc_id, owner, no_owner, 3, regexp_split_to_array(t, '[A-Za-z0-9+/_-]{24,}'), regexp_extract_all(t, '[A-Za-z0-9+/_-]{24,}'), regexp_extract_all(t, '[A-Za-z0-9+/_-]{24,}') FROM d),
e AS (SELECT doc_id, owner, no_owner, kind, unnest(range(1, len(f) + 1)) AS i, g, f, v FROM m WHERE len(f) > 0),
l AS (SELECT doc_id, owner, no_owner, kind, length(f[i]) AS n, length(g[i]) AS gap, f[i] AS match, v[i] AS value, i FROM e),
s AS (SELECT *, (sum(gap + n) OVER (PARTITION BY doc_id, kind ORDER BY i) - n)::BIGINT AS a FROM l),
c AS (
  SELECT doc_id, owner, no_owner, kind, a, a + n AS z, value,
    regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= 8 AS random
  FROM s WHERE CASE kind WHEN 0 THEN length(value) >= 12 WHEN 1 THEN n >= 18 WHEN 2 THEN n >= 16 ELSE true END),
k AS (SELECT * FROM c WHERE kind < 3 OR (random AND NOT EXISTS (
  SELECT 1 FROM c b WHERE b.doc_id = c.doc_id AND b.kind < 3 AND b.a < c.z AND c.a < b.z))),
o AS (SELECT value, CASE WHEN count(DISTINCT (owner, no_owner)) > 2 THEN 'example' WHEN bool_or(random) THEN 'live' ELSE 'weak' END AS verdict FROM k GROUP BY value),
j AS (SELECT k.*, verdict, concat_ws(':', ['assign', 'access', 'hex', 'opaque'][kind + 1], a, z) AS name
      FROM k JOIN o USING (value) WHERE kind < 3 OR verdict = 'live')
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(name, ',' ORDER BY a, kind) FILTER (kind < 3), '')) AS base_sha256,
  coalesce(string_agg(name, ',' ORDER BY a, kind), '') AS spans,
  count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example
FROM d LEFT JOIN j ON j.doc_id = d.doc_id GROUP BY d.doc_id
"""
