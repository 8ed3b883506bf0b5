"""Repair of conversations by an error-correcting Earley parser over a weighted role grammar.

The grammar gives the role initials (s?(ua)+)?. Its error productions delete a row, give it
another role, or insert an empty turn; each costs its weight. A chart column holds dotted
items, each with the least (cost, audit) of any way to it; the cheapest completed item of the
last column gives the repair. The rules are right-linear, so an item predicted from another
begins with that one's value and a column has no more items than the grammar has.

Spark damages the rows, deals and sorts them by conversation and turn; a task reads its
conversations as a stream and holds one at a time. A conversation is one row of the result,
with one hash over all its repaired text, so it isn't cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import SPACES

# Weights of the edits; faults.
KEEP, REROLE, DELETE, INSERT, TRUNCATED_COST = 0, 3, 4, 3, 3
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
ENDS = ".!?"
#: Left side, right side: terminals are initials, capitals are left sides.
RULES = (("C", ""), ("C", "sQ"), ("C", "uB"), ("Q", "uB"), ("B", "aE"), ("E", ""), ("E", "uB"))
#: The roles that rerole and insert may give.
GIVEN = {"u": "user", "a": "assistant"}


@dataclass(frozen=True, slots=True)
class Item:
    """A dotted rule in a column. cost and (rank, since) order all ways to the items of one
    column: rank is that of the audit up to the last row read, since the letters after it. No
    audit up to a row is a beginning of another up to the same row, so ranks order whole
    audits and none is copied. path leads back over (letter, given role) pairs."""

    rule: int
    dot: int
    cost: int
    rank: int
    since: str
    path: tuple | None

    @property
    def value(self) -> tuple[int, int, str]:
        return self.cost, self.rank, self.since

    @property
    def awaited(self) -> str:
        return RULES[self.rule][1][self.dot : self.dot + 1]


def _offer(column: dict, item: Item, agenda: list[Item]) -> None:
    key = item.rule, item.dot
    if key not in column or item.value < column[key].value:
        column[key] = item
        agenda.append(item)


def _step(item: Item, dot: int, cost: int, letter: str, role: str | None) -> Item:
    return Item(item.rule, dot, item.cost + cost, item.rank, item.since + letter, (item.path, letter, role))


def _closed(column: dict) -> dict:
    """Predictions and insertions of a column, until no item gets a lesser value."""
    agenda = list(column.values())
    while agenda:
        item = agenda.pop()
        if column[item.rule, item.dot] is not item:
            continue
        if item.awaited.isupper():
            for k, (left, _) in enumerate(RULES):
                if left == item.awaited:
                    _offer(column, Item(k, 0, item.cost, item.rank, item.since, item.path), agenda)
        elif item.awaited in GIVEN:
            _offer(column, _step(item, item.dot + 1, INSERT, "I", GIVEN[item.awaited]), agenda)
    return column


def _scanned(column: dict, initial: str, fault: str | None) -> dict:
    """The next column: each item that awaits a terminal reads or deletes the row."""
    after: dict = {}
    for item in column.values():
        want = item.awaited
        if want.isupper():
            continue
        _offer(after, _step(item, item.dot, DELETE, "D", None), [])
        if fault in (BLANK, DUPLICATE) or not want:
            continue
        more = TRUNCATED_COST if fault == TRUNCATED else 0
        if want == initial:
            _offer(after, _step(item, item.dot + 1, KEEP + more, "K", None), [])
        if want in GIVEN:
            _offer(after, _step(item, item.dot + 1, REROLE + more, "R", GIVEN[want]), [])
    ranks = {audit: i for i, audit in enumerate(sorted({(x.rank, x.since) for x in after.values()}))}
    return {key: Item(x.rule, x.dot, x.cost, ranks[x.rank, x.since], "", x.path) for key, x in after.items()}


def repair(rows: Iterable[tuple[str, str | None]]) -> tuple[int, list[tuple[str, str | None]]]:
    """rows: (role initial, fault) in order. Returns the least cost and the edits (letter,
    given role), of equally cheap ones those whose letters come first in ASCII."""
    column = _closed({(k, 0): Item(k, 0, 0, 0, "", None) for k, (left, _) in enumerate(RULES) if left == "C"})
    for initial, fault in rows:
        column = _closed(_scanned(column, initial, fault))
    best = min((x for x in column.values() if not RULES[x.rule][1]), key=lambda x: x.value)
    edits, path = [], best.path
    while path:
        path, letter, role = path
        edits.append((letter, role))
    return best.cost, edits[::-1]


#: Conversations of so many rows at most are parsed once for all of the same initials and faults.
SHORT = 32


@lru_cache(maxsize=1 << 16)
def _known(shape: tuple) -> tuple[int, list[tuple[str, str | None]]]:
    return repair(shape)


def faults_of(rows: list[tuple[str, str]]) -> list[str | None]:
    """The first fault of each (role, text)."""
    out, seen = [], set()
    for row in rows:
        body = row[1].rstrip(SPACES)
        out.append(BLANK if not body else DUPLICATE if row in seen else None if body[-1] in ENDS else TRUNCATED)
        seen.add(row)
    return out


def report(rows: list[tuple[int | None, str, str]]) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired text) of (turn, role,
    text) rows in order."""
    turns = {t for t, _, _ in rows if t is not None}
    said = [r[1:] for r in rows]
    faults = faults_of(said)
    initials = [role[:1] for role, _ in said]
    shape = tuple(zip(initials, faults, strict=True))
    cost, edits = _known(shape) if len(shape) <= SHORT else repair(shape)
    left, lines = iter(said), []
    for letter, given in edits:
        role, text = ("", "") if letter == "I" else next(left)
        if letter != "D":
            lines.append(f"{given or role}:{text}")
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal, cost, "".join(x for x, _ in edits), "\n".join(lines)


def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) after the damage that each row's id draws; a dropped
    row stays with gone = true and no text, so that its conversation is known. Null roles and
    texts are one space; null ids stay null (one conversation) but draw as one space."""
    said = df.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    said = said.withColumn("fate", F.crc32(F.encode(name, "UTF-8")) % 20)
    text = F.when(F.col("fate") <= 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    out = said.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fate") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1))).alias("copy"))
    return out.drop("copy")


RESULT = "conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired string"


def repaired(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text, gone), gone ones dropped: one row for each conv_id with
    its faults, the cheapest repair, its audit and the repaired text.

    Rows stand by turn (nulls first); rows of one turn by role, then text. A row whose role is
    the empty string has no initial, so it can't be kept. Null conv_ids are
    one conversation. A conversation without rows has zeros, an empty audit and no text. An
    empty table gives an empty result; other columns are not read."""
    kind = dict(rows.dtypes)["conv_id"]
    names = [c.split()[0] for c in RESULT.split(", ")]
    schema = pa.schema([pa.field(n, pa.string() if n in ("audit", "repaired") else pa.int64()) for n in names[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        now = begun = None

        def told(rows: list) -> pa.RecordBatch:
            columns = list(zip(*(report(r) for _, r in rows), strict=True))
            ids = pa.array([i for i, _ in rows], id_type)
            return pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(columns, schema, strict=True))], names)

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for conv, turn, role, text, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or conv != now:
                    if begun:
                        yield told([(now, held)])
                    held, now, begun = [], conv, True
                if not gone:
                    held.append((turn, role, text))
        if begun:
            yield told([(now, held)])

    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = rows.select("conv_id", "turn", "role", "text", "gone").repartition("conv_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, RESULT.format(kind=kind))


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    found = repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return found.select(*[c for c in found.columns if c != "repaired"], F.sha2(F.encode("repaired", "UTF-8"), 256).alias("repaired_sha256"))


#: States of the SQL: before all, after a system row, after a user row, after an assistant row;
#: each is the least (cost, audit, text) struct of its ways, or null.
_WAYS = {"e": ["D"], "q": ["D", "es"], "b": ["D", "eu", "qu", "fu"], "f": ["D", "ba"]}
_NONE = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR))"


def _way(before: str, cost: str, letter: str, line: str, when: str = "true") -> str:
    return f"CASE WHEN {before} IS NOT NULL AND {when} THEN {{'c': {before}.c + {cost}, 'a': {before}.a || '{letter}', 't': {before}.t || {line}}} END"


def _least(ways: list[str]) -> str:
    return f"list_min(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))"


def _read(state: str) -> str:
    """The state after one row."""
    out, clean, more = [], "fault NOT IN ('blank', 'duplicate')", "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
    for how in _WAYS[state]:
        if how == "D":
            out.append(_way(state, "4", "D", "''"))
            continue
        before, initial = how
        out.append(_way(before, more, "K", "chr(10) || role || ':' || text", f"{clean} AND i = '{initial}'"))
        if initial in GIVEN:
            out.append(_way(before, f"3 + {more}", "R", f"chr(10) || '{GIVEN[initial]}:' || text", clean))
    return _least(out)


def _inserted() -> str:
    """All states after one insertion at most."""
    user = [_way(s, "3", "I", "chr(10) || 'user:'") for s in "eqf"]
    return f"e, q, {_least(['b', *user])} AS b, {_least(['f', _way('b', '3', 'I', "chr(10) || 'assistant:'")])} AS f"


SQL = f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
drawn AS (
  SELECT *, xor(list_reduce(list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(name[i]) AS BIGINT)),
         lambda h, b: list_reduce(range(8), lambda c, i: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END), xor(h, b)), 4294967295), 4294967295) % 20 AS fate
  FROM named),
told AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM drawn, range(2) t(copy) WHERE fate <> 0 AND (copy = 0 OR fate = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS spot,
         regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS body FROM told),
judged AS (
  SELECT *, role[1] AS i, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY spot) AS before,
         CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY spot) > 1 THEN 'duplicate'
              WHEN body[-1] IN ('.', '!', '?') THEN '' ELSE 'truncated' END AS fault FROM placed),
summed AS (
  SELECT conv_id, max(spot) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS spot, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS e, {_NONE} AS q, {_NONE} AS b, {_NONE} AS f FROM summed
  UNION ALL
  SELECT w.conv_id, w.spot + 1, {_read('e')}, {_read('q')}, {_read('b')}, {_read('f')}
  FROM (SELECT conv_id, spot, {_inserted()} FROM (SELECT conv_id, spot, {_inserted()} FROM walk)) w
  JOIN judged j ON w.conv_id IS NOT DISTINCT FROM j.conv_id AND j.spot = w.spot + 1),
ended AS (
  SELECT s.*, {_least(['e', 'f'])} AS best
  FROM (SELECT conv_id, spot, {_inserted()} FROM (SELECT conv_id, spot, {_inserted()} FROM walk)) w JOIN summed s ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.spot = s.n)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN ended b ON a.conv_id IS NOT DISTINCT FROM b.conv_id
"""
