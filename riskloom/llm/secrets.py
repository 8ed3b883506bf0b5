"""Secret scan in DataFrame operations only.

Patterned secrets come from regular expressions; their positions are running sums of the
lengths of matches and of the pieces between them. Further candidates are long runs of
key-like characters, cut where a patterned secret stands. Over each a window slides one
character at a time; the window's character counts are updated by the character that enters
and the one that leaves, and with them the sum of c * log2(c), which gives the Shannon
entropy. A candidate counts from the first to the last window whose entropy reaches the
threshold of the candidate's character class. Allow-listed shapes (UUIDs, words, numbers,
dates, and names like "example" in the part that counts) are passed over.

Work and memory grow with the length of a text, whatever it holds: running sums are taken in
nested blocks, and a step of the window changes two characters of a fixed string of counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import documents, text_of

# Fixed values of the contract: the patterns of the three kinds and the least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
#: Runs are maximal, so asking for the least length in the pattern drops the same matches.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Character classes in the order tried: name, pattern, alphabet, entropy (bits) to reach.
CLASSES = (
    ("hex", r"^[0-9a-f]+$|^[0-9A-F]+$", 3.0),
    ("upper", r"^[A-Z0-9]+$", 3.4),
    ("base64", r"^.+$", 3.7),
)
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z]*([-_/=+][A-Za-z]*)*$",
    r"^[0-9]*([-_/=+][0-9]*)*$",
)
#: Looked for in the part of a candidate that counts.
ALLOWED_INSIDE = r"(?i)example|sample|dummy|placeholder"
_SPAN = "struct<start:int,rank:int,end:int,kind:string,match:string>"
SUM_BLOCK, SUM_LEVELS = 64, 2


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once although `use` names it often."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def running(xs: Column, levels: int = SUM_LEVELS) -> Column:
    """For each number of an array the sum of those before it. xs is a lambda's variable. Sums
    of blocks are taken first, so a number is added to those of its block only."""
    if levels == 0:
        return F.transform(xs, lambda _, i: _sum(F.slice(xs, F.lit(1), i)))
    count = F.greatest(F.lit(1), F.ceil(F.size(xs) / SUM_BLOCK).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(xs, b * SUM_BLOCK + 1, F.lit(SUM_BLOCK)))
    inside = lambda block, start: F.transform(block, lambda _, i: start + _sum(F.slice(block, F.lit(1), i)))
    return _let(blocks, lambda bs: F.flatten(F.zip_with(bs, _let(F.transform(bs, _sum), lambda sums: running(sums, levels - 1)), inside)))


def _pairs(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches, each with the piece before it; the last match is null."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))


def matches(text: Column, pattern: str, kind: str, rank: int) -> Column:
    """Leftmost non-overlapping matches as an array of spans in code points."""
    length = lambda p: F.length(p["piece"]) + F.length(p["match"])

    def span(p, before):
        return F.struct((before + F.length(p["piece"])).alias("start"), F.lit(rank).alias("rank"), (before + length(p)).alias("end"), F.lit(kind).alias("kind"), p["match"].alias("match"))

    real = F.filter(_pairs(text, pattern), lambda p: p["match"].isNotNull())
    found = _let(real, lambda ps: F.zip_with(ps, _let(F.transform(ps, length), running), span))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def blanked(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """The text with blanks in place of every match whose group is long enough."""
    fill = lambda m: F.when(F.length(F.regexp_extract(m, pattern, group)) >= least, F.repeat(F.lit(" "), F.length(m))).otherwise(m)
    whole = F.array_join(F.transform(_pairs(text, pattern), lambda p: F.concat(p["piece"], F.coalesce(fill(p["match"]), F.lit("")))), "")
    return F.when(text.rlike(pattern), whole).otherwise(text)


def _hot(candidate: Column, threshold: Column) -> Column:
    """struct(first, last): start of the first and end of the last window that reaches the
    threshold, or nulls. State of the walk: counts by character (a string of 128 characters,
    each chr(64 + count)) and the sum of c * log2(c)."""
    part = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    count = lambda counts, c: F.ascii(F.substr(counts, c + 1, F.lit(1))) - 64
    put = lambda counts, c, n: F.overlay(counts, F.chr(n + 64), c + 1, F.lit(1))
    start = F.struct(
        F.repeat(F.lit("@"), F.lit(128)).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )

    def step(acc, x):
        i, new, old = x["i"], x["new"], x["old"]
        same = old.isNotNull() & (new == old)
        moves = old.isNotNull() & (new != old)
        have, gone = count(acc["counts"], new), count(acc["counts"], old)
        added = F.when(same, acc["counts"]).otherwise(put(acc["counts"], new, have + 1))
        counts = F.when(moves, put(added, old, gone - 1)).otherwise(added)
        moved = F.when(same, F.lit(0.0)).otherwise(part(have + 1) - part(have) + F.when(moves, part(gone - 1) - part(gone)).otherwise(F.lit(0.0)))
        total = acc["sum"] + moved
        reached = (i >= WINDOW - 1) & (F.log2(F.lit(float(WINDOW))) - total / WINDOW >= threshold)
        return F.struct(
            counts.alias("counts"),
            total.alias("sum"),
            F.when(reached, F.coalesce(acc["first"], i - WINDOW + 1)).otherwise(acc["first"]).alias("first"),
            F.when(reached, i + 1).otherwise(acc["last"]).alias("last"),
        )

    # The walk is over pairs of characters, so its state stays small.
    codes = F.transform(F.split(candidate, ""), lambda c: F.ascii(c))
    pairs = _let(codes, lambda cs: F.transform(cs, lambda c, i: F.struct(i.alias("i"), c.alias("new"), F.get(cs, i - WINDOW).alias("old"))))
    return F.aggregate(pairs, start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _threshold(candidate: Column) -> Column:
    out = F.lit(CLASSES[-1][2])
    for _, pattern, bits in reversed(CLASSES[:-1]):
        out = F.when(candidate.rlike(pattern), F.lit(bits)).otherwise(out)
    return out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, base and extra, both arrays of spans (start, rank, end,
    kind, match), in code points with exclusive ends.

    A null text counts as empty and has no spans. Rows that repeat an id are scanned each.
    Ids may be null. An empty table gives an empty result. Other columns are not read.
    """
    rows = df.select(F.col(id_col), text_of(text_col).alias("t"))
    text = F.col("t")
    assign = F.filter(matches(text, ASSIGN, "assign", 0), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= ASSIGN_LEAST)
    base = F.concat(assign, matches(text, ACCESS, "access", 1), matches(text, HEX, "hex", 2))
    cut = blanked(blanked(blanked(text, ASSIGN, 2, ASSIGN_LEAST), ACCESS), HEX)
    rows = rows.select(id_col, "t", F.array_sort(base).alias("base"))
    rows = rows.withColumn("cut", F.when(F.size("base") > 0, cut).otherwise(text)).withColumn("runs", matches(F.col("cut"), CANDIDATE, "entropy", 3))

    def fine(run):
        m = run["match"]
        shaped = m.rlike("[0-9]") & m.rlike("[A-Za-z]")
        for pattern in ALLOWED:
            shaped = shaped & ~m.rlike(pattern)
        return shaped

    def narrowed(run):
        return _let(
            _let(_threshold(run["match"]), lambda bits: _hot(run["match"], bits)),
            lambda h: F.struct(
                (run["start"] + h["first"]).alias("start"),
                run["rank"].alias("rank"),
                (run["start"] + h["last"]).alias("end"),
                run["kind"].alias("kind"),
                F.substr(run["match"], h["first"] + 1, h["last"] - h["first"]).alias("match"),
            ),
        )

    extra = F.filter(F.transform(F.filter("runs", fine), narrowed), lambda s: s["start"].isNotNull() & ~s["match"].rlike(ALLOWED_INSIDE))
    return rows.select(id_col, "base", F.when(F.size("runs") > 0, extra).otherwise(F.array().cast(f"array<{_SPAN}>")).alias("extra"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "extra")).alias("spans"),
        F.size("extra").cast("long").alias("n_entropy"),
    )


def _sql_kind(kind: str, rank: int, pattern: str, keep: str, source: str = "d") -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, m[i] AS match,
         list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)::BIGINT AS start
  FROM (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT doc_id, regexp_extract_all(t, '{quoted}') AS m, string_split_regex(t, '{quoted}') AS p FROM {source})) WHERE {keep}"""


def _sql_blanked(source: str, pattern: str, group: int = 0, least: int = 0) -> str:
    q = pattern.replace("'", "''")
    fill = f"CASE WHEN length(regexp_extract(m[i], '{q}', {group})) >= {least} THEN repeat(' ', length(m[i])) ELSE coalesce(m[i], '') END"
    return f"""SELECT doc_id, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || {fill}), '') AS t
  FROM (SELECT doc_id, regexp_extract_all(t, '{q}') AS m, string_split_regex(t, '{q}') AS p FROM {source})"""


_BITS = "CASE " + " ".join(f"WHEN regexp_matches(match, '{p}') THEN {b}" for _, p, b in CLASSES) + " END"
_BARRED = " AND ".join(f"NOT regexp_matches(match, '{p}')" for p in ALLOWED)
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS (SELECT *, start + length(match) AS stop FROM ({_sql_kind("assign", 0, ASSIGN, f"length(regexp_extract(m[i], '{ASSIGN.replace(chr(39), chr(39) * 2)}', 2)) >= {ASSIGN_LEAST}")}
  UNION ALL {_sql_kind("access", 1, ACCESS, "true")}
  UNION ALL {_sql_kind("hex", 2, HEX, "true")})),
cut1 AS ({_sql_blanked("d", ASSIGN, 2, ASSIGN_LEAST)}),
cut2 AS ({_sql_blanked("cut1", ACCESS)}),
cut3 AS ({_sql_blanked("cut2", HEX)}),
runs AS (SELECT *, {_BITS} AS bits FROM ({_sql_kind("entropy", 3, CANDIDATE, "true", "cut3")}) r
  WHERE regexp_matches(match, '[0-9]') AND regexp_matches(match, '[A-Za-z]') AND {_BARRED}),
windows AS (SELECT doc_id, start, match, bits, w, substring(match, w + 1, {WINDOW}) AS part
  FROM (SELECT *, unnest(range(0, length(match) - {WINDOW - 1})) AS w FROM runs)),
chars AS (SELECT doc_id, start, match, bits, w, c, count(*) AS n
  FROM (SELECT doc_id, start, match, bits, w, unnest(string_split(part, '')) AS c FROM windows) GROUP BY ALL),
hot AS (SELECT doc_id, start, match, w FROM chars GROUP BY doc_id, start, match, bits, w
  HAVING log2({WINDOW}.0::DOUBLE) - sum(n * log2(n::DOUBLE)) / {WINDOW} >= min(bits)),
extra AS (SELECT doc_id, 3 AS rank, 'entropy' AS kind, start + min(w) AS start, start + max(w) + {WINDOW} AS stop FROM hot GROUP BY doc_id, hot.start, match
  HAVING NOT regexp_matches(substring(match, min(w) + 1, max(w) - min(w) + {WINDOW}), '{ALLOWED_INSIDE}')),
spans AS (SELECT doc_id, rank, kind, start, stop FROM base UNION ALL SELECT doc_id, rank, kind, start, stop FROM extra)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank), '') AS spans,
  count(*) FILTER (kind = 'entropy') AS n_entropy
FROM d LEFT JOIN spans ON d.doc_id = spans.doc_id GROUP BY d.doc_id
"""
