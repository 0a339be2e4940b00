"""Secret scan in DataFrame expressions only: fixed patterns, plus sliding-window Shannon entropy over candidate strings.

Base kinds are patterns with their positions. The method adds kind `entropy`: candidate strings (runs of token characters that
mix letters and digits) are slid over by a window; the window's character counts are kept up to date by one increment and one decrement a
step, with its sum of c*log2(c), so its entropy costs no recount. Each character class has its own threshold: hex digits, and
the wider base64 alphabet. A candidate whose best window reaches its class's threshold is a span, unless an allow-list pattern
suppresses it or it overlaps a base span. Base spans always stay.

`redact` masks more than `scan` lists, whose spans its SQL defines: candidates that overlap base spans too, and of candidates that hold a
marked example the runs of path segments without a mark, judged as candidates of their own.

Positions are code points, ends exclusive. Patterns have no positions in Spark SQL, so they come from the lengths of the text
between matches (`split`) and of the matches (`regexp_extract_all`), which alternate.

Defined results: null text is empty and has no spans; ties and repeated rows count each by itself; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Least length: of an assignment's value, of an access key, of a run of hex digits.
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "entropy")
#: Candidates: runs of at least WINDOW token characters.
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{%d,}" % WINDOW
#: Least entropy in bits of a window, by character class.
HEX_BITS, BASE64_BITS = 3.0, 3.9
#: Marks of examples.
MARKED = r"(?i:0123456789|abcdefghij|example|placeholder|xxxxx)"
#: Candidates that are no secrets: no digit or no letter, UUIDs, runs of the alphabet or of digits, and marked examples.
ALLOW = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    MARKED,
)

#: A candidate in which no letter touches a digit, and without a plus sign, is a path or slug of words and numbers, and allowed.
TOUCHING = r"[A-Za-z][0-9]|[0-9][A-Za-z]|[+]"

_SPAN = "array<struct<s:int,k:int,e:int>>"


def _alternate(text: Column, pattern: str, kind: int, good, values_of: int = 0) -> Column:
    """Spans of the pattern's matches for whose group `values_of` good() holds. One pass over the gaps and matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(pattern), F.lit(values_of))
    marked = F.zip_with(found, kept, lambda m, v: F.struct(F.char_length(m).alias("n"), good(v).alias("ok")))
    steps = F.zip_with(F.split(text, pattern, -1), marked, lambda a, m: F.struct(F.char_length(a).alias("gap"), F.coalesce(m["n"], F.lit(0)).alias("n"), F.coalesce(m["ok"], F.lit(False)).alias("ok")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc, x):
        s = acc["at"] + x["gap"]
        e = s + x["n"]
        span = F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e"))
        return F.struct(e.alias("at"), F.when(x["ok"], F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def window_bits(text: Column, window: int) -> Column:
    """Largest Shannon entropy in bits of the windows of `window` characters of an ASCII text (the whole text if it is shorter).

    State of the fold: counts by character code, the sum of c*log2(c), the most bits so far. Each character adds one to its own
    count; from the window's length on, the one that leaves takes one off.
    """
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    n = F.char_length(text)
    leaving = F.concat(F.array_repeat(F.lit(-1), window), codes)
    pairs = F.zip_with(codes, F.slice(leaving, F.lit(1), n), lambda new, old: F.struct(new.alias("new"), old.alias("old")))
    term = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))
    zero = F.struct(F.lit(0).alias("i"), F.array_repeat(F.lit(0.0), 128).alias("c"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def step(acc, x):
        new, old, i = x["new"], x["old"], acc["i"] + 1
        came = acc["c"][new]
        left = F.when(old >= 0, acc["c"][F.greatest(old, F.lit(0))])
        sum_ = F.when(new == old, acc["sum"]).otherwise(acc["sum"] + term(came + 1) - term(came) + F.coalesce(term(left - 1) - term(left), F.lit(0.0)))
        counts = F.when(new == old, acc["c"]).otherwise(F.transform(acc["c"], lambda c, j: F.when(j == new, c + 1).when(j == old, c - 1).otherwise(c)))
        size = F.least(i, F.lit(window)).cast("double")
        best = F.when((i >= window) | (i == n), F.greatest(acc["best"], F.log2(size) - sum_ / size)).otherwise(acc["best"])
        return F.struct(i.alias("i"), counts.alias("c"), sum_.alias("sum"), best.alias("best"))

    return F.when(n > 0, F.aggregate(pairs, zero, step, lambda acc: acc["best"])).otherwise(F.lit(0.0))


def _random(value: Column) -> Column:
    """Whether a candidate's entropy reaches the threshold of its character class and no allow-list pattern holds."""
    allowed = ~value.rlike(TOUCHING)
    for p in ALLOW:
        allowed = allowed | value.rlike(p)
    least = F.when(value.rlike("^[0-9a-fA-F]+$"), F.lit(HEX_BITS)).otherwise(F.lit(BASE64_BITS))
    return F.when(allowed, F.lit(False)).otherwise(F.round(window_bits(value, WINDOW), 9) >= least)


def _unmarked(text: Column) -> Column:
    """Random spans in the runs of path segments without a mark, of the text's candidates that hold a mark."""
    long_random = lambda v: F.when(F.char_length(v) >= WINDOW, _random(v)).otherwise(F.lit(False))

    def inside(x):
        part = text.substr(x["s"] + 1, x["e"] - x["s"])
        return F.transform(_alternate(part, _SEGMENTS, 3, long_random), lambda y: F.struct((y["s"] + x["s"]).alias("s"), y["k"].alias("k"), (y["e"] + x["s"]).alias("e")))

    return F.flatten(F.transform(F.filter(_alternate(text, _MIXED, 3, lambda v: v.rlike(MARKED)), lambda x: x["e"] > x["s"]), inside))


def with_spans(docs: DataFrame, text_col: str = "text", every: bool = False) -> DataFrame:
    """docs with columns _text (null as empty), _base and _more: sorted spans (s, k: index of KINDS, e). every: for redact."""
    text, none = F.col("_text"), F.array().cast(_SPAN)
    long_as = lambda least: lambda v: F.char_length(v) >= least
    # A cheap test first: most texts hold none of the candidates, and then nothing of them is split.
    found = docs.withColumn("_text", F.coalesce(F.col(text_col).cast("string"), F.lit(""))).withColumns({
        "_assign": F.when(text.rlike(ASSIGN), _alternate(text, ASSIGN, 0, long_as(LEAST["assign"]), 2)).otherwise(none),
        "_access": F.when(F.contains(text, F.lit("AKIA")), _alternate(text, ACCESS, 1, long_as(LEAST["access"]))).otherwise(none),
        "_hex": F.when(text.rlike(_HEX_LONG), _alternate(text, _HEX_LONG, 2, long_as(LEAST["hex"]))).otherwise(none),
        "_some": F.when(text.rlike(_MIXED), _alternate(text, _MIXED, 3, _random)).otherwise(none),
    })
    based = found.withColumn("_base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    if every:
        return based.withColumn("_more", F.concat("_some", F.when(F.contains(text, F.lit("/")) & text.rlike(MARKED) & text.rlike(_MIXED), _unmarked(text)).otherwise(none))).drop("_assign", "_access", "_hex", "_some")
    apart = F.filter("_some", lambda x: ~F.exists("_base", lambda y: (y["s"] < x["e"]) & (y["e"] > x["s"])))
    return based.withColumn("_more", apart).drop("_assign", "_access", "_hex", "_some")


#: Maximal runs long enough to count: the same as all maximal runs of which short ones are dropped. They start where the run starts.
_HEX_LONG = r"(?<![0-9a-f])[0-9a-f]{%d,}" % LEAST["hex"]
#: Candidates that mix letters and digits.
_MIXED = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])" + CANDIDATE
#: A run of path segments without a mark. Possessive, as other groups recur.
_SEGMENT = r"(?![A-Za-z0-9+_-]*?" + MARKED + r")[A-Za-z0-9+_-]"
_SEGMENTS = r"(?<![A-Za-z0-9+_-])" + _SEGMENT + r"++(?:/" + _SEGMENT + r"*+)*+"


def _written(spans: Column) -> Column:
    kind = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256 and spans, both of `kind:start:end` by start, then kind."""
    rows = with_spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    count = lambda k: F.size(F.filter("_base", lambda x: x["k"] == k)).cast("long")
    return rows.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.size("_more").cast("long").alias("n_entropy"),
        F.sha2(_written(F.col("_base")), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("_base", "_more"))).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mask: str = "<secret>") -> DataFrame:
    """docs with every span of its text replaced by `mask`; overlapping spans by one. Rows without spans are unchanged."""
    rows = with_spans(docs, text_col, every=True)
    every = F.array_sort(F.concat("_base", "_more"))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        apart = x["s"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(apart, F.concat(acc["out"], F.col("_text").substr(acc["at"] + 1, x["s"] - acc["at"]), F.lit(mask))).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(every, zero, step, lambda acc: F.concat(acc["out"], F.col("_text").substr(acc["at"] + 1, F.char_length("_text"))))
    hit = F.size("_base") + F.size("_more") > 0
    return rows.select(*(F.when(hit, clean).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns))


#: DuckDB SQL of the registered query.
ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT rid, 0 AS k, string_split_regex(text, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?(?:[A-Za-z0-9+/_.=-]+)') AS gaps,
    regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS found,
    list_transform(regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda v: length(v) >= 6) AS ok FROM t
  UNION ALL SELECT rid, 1, string_split_regex(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0),
    list_transform(regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), lambda v: length(v) >= 20) FROM t
  UNION ALL SELECT rid, 2, string_split_regex(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+', 0),
    list_transform(regexp_extract_all(text, '[0-9a-f]+', 0), lambda v: length(v) >= 24) FROM t
  UNION ALL SELECT rid, 3, string_split_regex(text, '[A-Za-z0-9+/_-]{20,}'), regexp_extract_all(text, '[A-Za-z0-9+/_-]{20,}', 0),
    list_transform(regexp_extract_all(text, '[A-Za-z0-9+/_-]{20,}', 0), lambda v: regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
      AND NOT regexp_matches(v, '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$')
      AND regexp_matches(v, '[A-Za-z][0-9]|[0-9][A-Za-z]|[+]')
      AND NOT regexp_matches(v, '(?i)0123456789|abcdefghij|example|placeholder|xxxxx')
      AND list_max(list_transform(range(1, length(v) - 18), lambda j: round(list_entropy(string_split(substr(v, j, 20), '')), 9)))
        >= CASE WHEN regexp_matches(v, '^[0-9a-fA-F]+$') THEN 3.0 ELSE 3.9 END) FROM t
), e AS (SELECT rid, k, gaps, found, ok, unnest(range(1, len(found) + 1)) AS i FROM m),
g AS (SELECT rid, k, gaps, found, i FROM e WHERE ok[i]),
p AS (
  SELECT rid, k, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s,
    length(found[i]) AS n FROM g
), q AS (SELECT * FROM p WHERE k < 3 UNION ALL SELECT * FROM p WHERE k = 3 AND NOT EXISTS (SELECT 1 FROM p AS o WHERE o.rid = p.rid AND o.k < 3 AND o.s < p.s + p.n AND o.s + o.n > p.s)),
w AS (SELECT rid, k, s, concat_ws(':', ['assign', 'access', 'hex', 'entropy'][k + 1], s, s + n) AS x FROM q),
r AS (SELECT rid, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c, count(*) FILTER (k = 3) AS d,
  string_agg(x, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(x, ',' ORDER BY s, k) AS spans FROM w GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, coalesce(d, 0) AS n_entropy,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN r USING (rid)
"""
