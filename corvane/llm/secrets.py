"""Secret scans with multipart credential linking, in DataFrame operations alone.

Three strong patterns (assign, access, hex) are found in whole texts. Three weak ones are
candidates only: names of accounts (login), mixed tokens (key) and addresses (endpoint). An
interval join within each document links parts whose gap is at most SCOPE characters; a weak
candidate is reported only where complementary parts lie in its scope: a login beside a secret,
a key beside an identifier, an endpoint beside both. Candidates that overlap a strong span are
no further finding.

Positions come from the lengths of matches and of what lies between them, in code points and in
bytes, by a running sum over blocks of matches (_running), whose work grows in proportion to them.
Matching is a map-only pass; its arrays, a few bytes a document, are written to the shared folder, so that texts are
scanned once. The join asks for each part only its nearest neighbour of either class on either
side, found by two running windows over the parts of one document: linear, without pairs. Parts
are keyed by document, so no group is larger than a document. Links return to documents by an
equi-join that the planner may split or broadcast as measured.

Cases: a null text is empty; fewer than the required characters drop a match, whose text stays
consumed; letters of the assign words are matched in either case within ASCII; repeated rows get
equal results; a null id is a key like any other; an empty table gives no rows; other columns
are ignored, or kept untouched by redact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm import common

SCOPE = 200
#: Kind, pattern, group whose length counts, least length. The first three are strong.
PATTERNS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
    ("login", r"""(?i)(?:user_?name|user|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]+)""", 1, 3),
    ("key", r"[A-Za-z0-9+/_-]{20,}={0,2}", 0, 20),
    ("endpoint", r"[a-z][a-z0-9+.]{1,15}://[A-Za-z0-9._~:/?#@%&=+-]+", 0, 8),
]
#: What a match must hold besides: a key mixes digits and letters of both cases.
_HOLDS = {"key": ("[0-9]", "[a-z]", "[A-Z]")}
KINDS = [p[0] for p in PATTERNS]
_STRONG = 3
#: A cheap sign that a kind may occur; only then are its matches cut out.
_SIGNS = {"assign": r"(?i)(?:passw|secret|token|api_?key)", "access": "AKIA[A-Z0-9]{14}", "hex": "[0-9a-f]{16}", "login": r"(?i)(?:user|login|account|client_?id|key_?id)", "key": "[A-Za-z0-9+/_-]{20}", "endpoint": "://"}
#: Positions in code points, end exclusive; off: how many bytes more than code points lie before the span (spans are ASCII).
_SPAN = "array<struct<start:int,ord:int,kind:string,end:int,off:int>>"
#: Elements of an array that are folded at a time.
_BLOCK = 64


def _bound(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(items: Column, start: dict[str, Column], kind: str, carry, merge, step) -> Column:
    """What step(state, item) puts into the array state.out over all items.

    A fold copies its whole state at every step, so no state may hold what all items gave: carry(state,
    item) sums up each block of items alone, merge(state, state) adds the sums up to where each
    block starts, and step folds each block from there. get() reads one item where slice() would copy all."""
    first = F.struct(*[c.alias(n) for n, c in start.items()])
    cut = lambda a, k: F.transform(F.sequence(k * _BLOCK, F.least(k * _BLOCK + _BLOCK, F.size(a)) - 1), lambda i: F.get(a, i))
    blocks = _bound(items, lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _BLOCK).cast("int")), lambda k: cut(a, k)))
    starts = lambda parts: F.aggregate(F.transform(parts, lambda p: F.aggregate(p, first, carry)), F.array(first), lambda done, s: F.concat(done, F.array(merge(F.element_at(done, -1), s))))

    def folded(parts, begins):
        at = lambda k: F.struct(*[F.get(begins, k)[n].alias(n) for n in start], F.array().cast(kind).alias("out"))
        return F.flatten(F.transform(parts, lambda p, k: F.aggregate(p, at(k), step)["out"]))

    return _bound(blocks, lambda parts: _bound(starts(parts), lambda begins: folded(parts, begins)))


def _matches(text: Column, ord_: int) -> Column:
    """All spans of one kind."""
    kind, pattern, group, least = PATTERNS[ord_]
    pat = F.lit(pattern)
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pat, F.lit(0)).alias("whole"), F.regexp_extract_all(text, pat, F.lit(group)).alias("part"),
    )

    def step(s, x):
        a = s["at"] + F.length(x["gap"])
        off = s["off"] + F.octet_length(x["gap"]) - F.length(x["gap"])
        b = a + F.coalesce(F.length(x["whole"]), F.lit(0))
        span = F.array(F.struct(a.alias("start"), F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"), b.alias("end"), off.alias("off"))).cast(_SPAN)
        ok = F.coalesce(F.length(x["part"]) >= least, F.lit(False))
        for sign in _HOLDS.get(kind, ()):
            ok = ok & F.rlike(x["whole"], F.lit(sign))
        return F.struct(b.alias("at"), off.alias("off"), F.when(ok, F.concat(s["out"], span)).otherwise(s["out"]).alias("out"))

    def carry(s, x):
        at = s["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["whole"]), F.lit(0))
        return F.struct(at.alias("at"), (s["off"] + F.octet_length(x["gap"]) - F.length(x["gap"])).alias("off"))

    merge = lambda s, t: F.struct((s["at"] + t["at"]).alias("at"), (s["off"] + t["off"]).alias("off"))
    found = _running(parts, {"at": F.lit(0), "off": F.lit(0)}, _SPAN, carry, merge, step)
    return F.when(F.rlike(text, F.lit(_SIGNS[kind])), found).otherwise(F.array().cast(_SPAN))


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), strong and weak (arrays of spans by start) of each row."""
    df = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = lambda kinds: F.array_sort(F.concat(*[_matches(F.col("text"), k) for k in kinds]))
    return df.select("doc_id", F.xxhash64("text").alias("h"), found(range(_STRONG)).alias("strong"), found(range(_STRONG, len(PATTERNS))).alias("weak"))


def _linked(found: DataFrame, scope: int) -> DataFrame:
    """doc_id, h and more: the weak spans that complementary parts support."""
    some = found.where(F.size("weak") > 0).dropDuplicates(["doc_id", "h"])
    rows = some.select("doc_id", "h", F.explode(F.concat("strong", "weak")).alias("p")).select("doc_id", "h", "p.*")
    classes = {"ident": F.col("kind").isin("access", "login"), "secret": F.col("kind").isin("assign", "hex", "key"), "strong": F.col("ord") < _STRONG}
    key = ["doc_id", "h"]
    before = W.partitionBy(key).orderBy("start", "ord", "end").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(key).orderBy(F.desc("start"), F.desc("ord"), F.desc("end")).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({f"{n}_left": F.max(F.when(c, F.col("end"))).over(before) for n, c in classes.items()})
    rows = rows.withColumns({f"{n}_right": F.min(F.when(c, F.col("start"))).over(after) for n, c in classes.items()})
    near = lambda n: F.coalesce(F.col("start") - F.col(f"{n}_left") <= scope, F.lit(False)) | F.coalesce(F.col(f"{n}_right") - F.col("end") <= scope, F.lit(False))
    inside = F.coalesce(F.col("strong_left") > F.col("start"), F.lit(False)) | F.coalesce(F.col("strong_right") < F.col("end"), F.lit(False))
    wanted = F.when(F.col("kind") == "login", near("secret")).when(F.col("kind") == "key", near("ident")).when(F.col("kind") == "endpoint", near("secret") & near("ident"))
    kept = rows.where((F.col("ord") >= _STRONG) & ~inside & wanted)
    return kept.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "ord", "kind", "end", "off")).alias("more"))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row: doc_id, h, strong and spans (strong and linked weak ones), arrays of (start, ord, kind, end, off) by start."""
    found = common.written(parts(docs), "parts")
    more = _linked(found, scope).withColumnsRenamed({"doc_id": "__id", "h": "__h"})
    joined = found.join(more, found["doc_id"].eqNullSafe(more["__id"]) & (found["h"] == more["__h"]), "left")
    return joined.select("doc_id", "h", "strong", F.array_sort(F.concat("strong", F.coalesce(F.col("more").cast(_SPAN), F.array().cast(_SPAN)))).alias("spans"))


def _said(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (text) from scan()."""
    count = lambda k: F.size(F.filter("strong", lambda s: s["ord"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(count, range(_STRONG)), F.sha2(_said("strong"), 256).alias("base_sha256"), _said("spans").alias("spans"))


#: Bytes that stay, and the kind of the span after them.
_CUT = "array<struct<from:int,to:int,kind:string>>"


def redact(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """docs, all columns, each span of scan() in text replaced by its kind in square brackets."""
    found = scan(docs, scope).where(F.size("spans") > 0).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), F.col("spans").alias("__spans")).dropDuplicates(["__id", "__h"])
    found = common.written(found, "spans")
    rows = docs.join(found, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__h")), "left")
    text = F.col("text").cast("string")
    end = F.length(text)
    last = F.array(F.struct(end.alias("start"), F.lit(len(PATTERNS)).alias("ord"), F.lit("").alias("kind"), end.alias("end"), (F.octet_length(text) - end).alias("off"))).cast(_SPAN)

    def step(s, x):  # at: byte up to which the text is told or left out
        a, b = x["start"] + x["off"], x["end"] + x["off"]
        cut = F.array(F.struct(s["at"].alias("from"), a.alias("to"), x["kind"].alias("kind"))).cast(_CUT)
        return F.struct(F.greatest(s["at"], b).alias("at"), F.when(a >= s["at"], F.concat(s["out"], cut)).otherwise(s["out"]).alias("out"))

    carry = lambda s, x: F.struct(F.greatest(s["at"], x["end"] + x["off"]).alias("at"))
    merge = lambda s, t: F.struct(F.greatest(s["at"], t["at"]).alias("at"))
    cuts = _running(F.concat("__spans", last), {"at": F.lit(0)}, _CUT, carry, merge, step)
    told = lambda raw: F.transform(cuts, lambda c: F.concat(F.substring(raw, c["from"] + 1, c["to"] - c["from"]).cast("string"), F.when(c["kind"] == "", "").otherwise(F.concat(F.lit("["), c["kind"], F.lit("]")))))
    cleared = F.array_join(F.get(F.transform(F.array(text.cast("binary")), told), F.lit(0)), "")
    return rows.withColumn("text", F.when(F.col("__spans").isNotNull(), cleared).otherwise(F.col("text"))).select(docs.columns)


def _sql_spans(place: int) -> str:
    kind, pattern, group, least = PATTERNS[place]
    pattern = pattern.replace("'", "''")
    holds = "".join(f" AND regexp_matches(m, '{sign}')" for sign in _HOLDS.get(kind, ()))
    return f"""SELECT doc_id, {place} AS ord, '{kind}' AS kind, a, a + length(m) AS z FROM (
  SELECT doc_id, m, part, CAST(list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[: i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
  FROM (SELECT doc_id, gaps, ms, unnest(ms) AS m, unnest(ps) AS part, generate_subscripts(ms, 1) AS i
    FROM (SELECT doc_id, regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS ms, regexp_extract_all(text, '{pattern}', {group}) AS ps FROM d))) WHERE length(part) >= {least}{holds}"""


_NEAR = "EXISTS (SELECT 1 FROM parts q WHERE q.doc_id = p.doc_id AND q.kind IN ({0}) AND q.z >= p.a - {1} AND q.a <= p.z + {1})"
_SECRET, _IDENT = _NEAR.format("'assign', 'hex', 'key'", SCOPE), _NEAR.format("'access', 'login'", SCOPE)
ORACLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
parts AS ({' UNION ALL '.join(_sql_spans(k) for k in range(len(PATTERNS)))}),
weak AS (SELECT p.* FROM parts p WHERE ord >= {_STRONG} AND NOT EXISTS (SELECT 1 FROM parts q WHERE q.doc_id = p.doc_id AND q.ord < {_STRONG} AND q.a < p.z AND q.z > p.a)
  AND CASE kind WHEN 'login' THEN {_SECRET} WHEN 'key' THEN {_IDENT} ELSE {_SECRET} AND {_IDENT} END),
base AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n0, count(*) FILTER (ord = 1) AS n1, count(*) FILTER (ord = 2) AS n2, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, ord) AS said FROM parts WHERE ord < {_STRONG} GROUP BY 1),
whole AS (SELECT doc_id, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, ord) AS said FROM (SELECT * FROM parts WHERE ord < {_STRONG} UNION ALL SELECT * FROM weak) GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex, sha256(coalesce(base.said, '')) AS base_sha256, coalesce(whole.said, '') AS spans
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN whole USING (doc_id)"""
