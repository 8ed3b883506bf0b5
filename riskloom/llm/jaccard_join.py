"""Exact Jaccard join of documents on word shingles, with a token-group matrix.

1. Every text becomes a sorted set of shingle hashes (mapInArrow). Equal sets form a class at
   once, with map-side combining, so copies are never compared or paired.
2. Tokens of the low part of the hash space (a fixed share, the same for all documents) are
   counted over all classes. A document's tokens are ordered rarest first; two sets that link
   must share one of their first n - ceil(t n) + 1 tokens. A document with that many tokens
   of its own cannot link with anything and drops out here.
   This is done twice: on the low hash range of all classes, then on the whole sets of those
   that are left, where only tokens they share with each other count.
3. Settling. Those left are partitioned into groups of bounded size by their smallest shared
   token; a group's sets are compared exactly and each of its components keeps one head. The
   heads under one token meet in groups again, for as long as a meeting at least halves them,
   then the heads left meet under another of their tokens. So a family of N near copies is
   read about once, in log N meetings, and gets one label.
4. The token-group matrix (token, group, bounds) is made of groups of one label and of groups
   of documents that settled alone. Two groups meet only if they share a token, can reach the
   threshold by their sizes and by the tokens they share with anything at all, hold different
   labels, and were not compared before. Per token the label with most groups never asks: it
   is only asked, so a settled family costs nothing more.
5. For each group the union of its members' tokens bounds a query's overlap; only qualifying
   groups are opened, and there overlaps with all members are counted exactly. What leaves is
   a link of two labels, once for each pair of labels that a group ties.
6. Labels are joined into components.

No bucket is capped: a frequent key is cut into blocks, each of which every query meets.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import HOT_KEYS, documents, salt_of, salted_lookup, workers_ready, written
from riskloom.llm.components import connected_components
from riskloom.llm.shingles import mix, sets_of

BLOCK = 128
CHUNK = 128
#: Tokens that a group compares at once, so that long texts make small groups.
BLOCK_TOKENS = 1 << 21
HOT_SALTS = 64
#: Keys under which documents meet before the matrix is made, one after the other.
KEYS, ENOUGH = 4, 32
#: Groups of documents that settled alone are kept apart by how many tokens no other document has.
CLASSES = 8
_SET = "cid binary, tokens array<bigint>"
_SKETCH = "id bigint, print bigint, cid binary, n bigint, low bigint, sketch array<bigint>"
_SETTLED = "cid binary, head binary"
_TIES = "a binary, b binary"


def _digest(s: np.ndarray) -> bytes:
    return np.array([s.sum(dtype=np.uint64), mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)], np.uint64).tobytes()


def prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    values = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _pieces(batches, rows: int = 256):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _sketches(batches, k: int, percent: int, edge: int):
    with np.errstate(over="ignore"):
        for batch in _pieces(batches):
            cids, counts, lows, sketches = [], [], [], []
            for s in sets_of(batch.column(2), k):
                low, least = int(np.searchsorted(s, np.uint64(edge))), prefix_length(len(s), percent)
                cids.append(_digest(s))
                counts.append(len(s))
                lows.append(low)
                sketches.append(s[: max(low, least) if len(s) else 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cids, pa.binary()), pa.array(counts, pa.int64()), pa.array(lows, pa.int64()), _lists(sketches)], ["id", "print", "cid", "n", "low", "sketch"])


def _whole_sets(batches, k: int):
    with np.errstate(over="ignore"):
        for batch in _pieces(batches):
            sets = list(sets_of(batch.column(1), k))
            yield pa.RecordBatch.from_arrays([pa.array(list(map(_digest, sets)), pa.binary()), _lists(sets)], ["cid", "tokens"])


class _Members:
    """The sets of a group by token: which members have each token of their union."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(x) for x in sets])
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.owner, tokens = owner[order], tokens[order]
        self.union, self.first = np.unique(tokens, return_index=True)
        self.last = np.append(self.first[1:], len(tokens))

    def linked(self, s: np.ndarray, percent: int) -> np.ndarray:
        """The members that link with the set s."""
        at = np.minimum(np.searchsorted(self.union, s), len(self.union) - 1)
        at = at[self.union[at] == s]
        if not len(at) or len(at) < -(-percent * len(s) // 100):
            return np.zeros(0, int)  # the union's overlap bounds that with every member
        first, length = self.first[at], self.last[at] - self.first[at]
        ends = np.cumsum(length)
        index = np.arange(ends[-1]) - np.repeat(ends - length, length) + np.repeat(first, length)
        common = np.bincount(self.owner[index], minlength=len(self.sizes))
        return np.flatnonzero(100 * common >= percent * (len(s) + self.sizes - common))


class _Parts:
    """Disjoint sets of 0 .. n - 1."""

    def __init__(self, n: int) -> None:
        self.head = list(range(n))

    def find(self, x: int) -> int:
        while self.head[x] != x:
            self.head[x] = self.head[self.head[x]]
            x = self.head[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.head[x] = y
        return x != y


def _sets(table: pa.Table) -> list[np.ndarray]:
    lists = table["tokens"].combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return [flat[at[i] : at[i + 1]] for i in range(len(lists))]


def _settle(table: pa.Table, percent: int) -> pa.Table:
    """Compares the documents of a group (each cid once) and names the head of each component:
    the one that shares most tokens with others, so the likeliest to link with further heads."""
    sets, m = _sets(table), table.num_rows
    members, parts = _Members(sets), _Parts(m)
    for i, s in enumerate(sets):
        for j in members.linked(s, percent).tolist():
            parts.join(i, j)
    cids, shared = table["cid"].to_pylist(), table["s"].to_pylist()
    best: dict[int, int] = {}
    for i in range(m):
        part = parts.find(i)
        best[part] = min(best.get(part, i), i, key=lambda x: (-shared[x], cids[x]))
    heads = pa.array([cids[best[parts.find(i)]] for i in range(m)], pa.binary())
    return table.select(["cid"]).append_column("head", heads)


def _ties(table: pa.Table, percent: int) -> pa.Table:
    """Members (role 0) and queries (role 1) of a group, each with its label; returns links of
    labels, as a tree over those that the group ties together."""
    roles, sets = np.array(table["role"].to_pylist()), _sets(table)
    names: dict[bytes, int] = {}
    label = np.array([names.setdefault(x, len(names)) for x in table["label"].to_pylist()])
    inside = np.flatnonzero(roles == 0)
    out: list[tuple[int, int]] = []
    if len(inside):
        members, parts = _Members([sets[i] for i in inside]), _Parts(len(names))
        for i in np.flatnonzero(roles == 1).tolist():
            for other in np.unique(label[inside[members.linked(sets[i], percent)]]).tolist():
                if parts.join(int(label[i]), other):
                    out.append((int(label[i]), other))
    by = list(names)
    return pa.table({"a": pa.array([by[x] for x, _ in out], pa.binary()), "b": pa.array([by[y] for _, y in out], pa.binary())})


def _rare_first(classes: DataFrame, percent: int, edge: int | None) -> DataFrame:
    """classes(num, cid, n, low, sketch) to (cid, n, s, prefix, keys) for the classes that may link.
    num names a class in a few bytes: postings are its number and a token, nothing else moves.

    The order of tokens: those of the low hash range (all of them if edge is None) by the
    number of classes that have them, then the others. Tokens of one class only come first and
    match nothing; a class whose prefix has no others is left out. s is the number of its tokens
    that another class has, keys the smallest of them by KEYS hashes, each with its count (df;
    more for long sets, so that df tells how many blocks hold them).
    """
    df = F.count(F.lit(1))
    # Only where keys are asked for, long sets weigh more; any order that all sets share will do.
    weight = df if edge is not None else F.greatest(df, F.expr(f"sum(n) div {BLOCK_TOKENS // BLOCK}"))
    counts = classes.select("n", F.explode("sketch").alias("token")).groupBy("token").agg(weight.alias("df"), df.alias("classes")).where("classes > 1").drop("classes")
    counts = written(counts, "tokens")
    total = classes.agg(F.sum(F.size("sketch"))).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("df") > max(BLOCK, total // HOT_KEYS)).select("token", F.lit(True).alias("hot")))  # HOT_KEYS rows at most
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = counts.join(hot, "token", "left").withColumn("salt", F.explode(salts)).drop("hot")
    postings = classes.select("num", F.explode("sketch").alias("token")).join(hot, "token", "left")
    postings = postings.withColumn("salt", F.when(F.col("hot"), salt_of(HOT_SALTS, "num")).otherwise(0)).drop("hot").join(repeated, ["token", "salt"])
    # Both lists grow row by row, so their entries belong together; as two they take half the bytes.
    shared = postings.groupBy("num").agg(F.collect_list("df").alias("df"), F.collect_list("token").alias("token"))
    shared = shared.join(classes.select("num", "cid", "n", "low"), "num").withColumn("shared", F.sort_array(F.arrays_zip("df", "token")))
    is_low = lambda x: (x["token"] >= 0) & (x["token"] < F.lit(edge))
    shared = shared.withColumn("low_shared", F.col("shared") if edge is None else F.filter("shared", is_low))
    least = F.col("n") - F.expr(f"(n * {percent} + 99) div 100") + 1
    shared = shared.withColumn("room", (least - (F.col("low") - F.size("low_shared"))).cast("int")).where("room > 0")
    prefix = F.slice("low_shared", F.lit(1), F.col("room"))
    if edge is not None:
        prefix = F.concat(prefix, F.filter("shared", lambda x: ~is_low(x)))
    least_by = lambda j: F.array_min(F.transform("shared", lambda x: F.struct((x["token"] if j == 0 else F.xxhash64(x["token"], F.lit(j))).alias("at"), x["token"].alias("token"), x["df"].alias("df"))))
    keys = F.array(*map(least_by, range(KEYS)))
    return shared.select("cid", "n", F.size("shared").cast("long").alias("s"), F.transform(prefix, lambda x: x["token"]).alias("prefix"), keys.alias("keys")).where(F.size("prefix") > 0)


def _at(task, percent: int):
    def of_group(table: pa.Table) -> pa.Table:
        return task(table, percent)

    return of_group


def _blocks(count: str, mass: str):
    return F.expr(f"greatest(1, ({count} + {BLOCK - 1}) div {BLOCK}, {mass} div {BLOCK_TOKENS})").cast("long")


def _settled(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """docs(cid, n, s, keys) to (cid, label): documents with one label are in one component.
    Heads meet under one key after the other, for as long as that joins one in ENOUGH of them."""
    moves: list[DataFrame] = []
    left, before = docs, docs.count()

    def counted(heads: DataFrame, least: str) -> DataFrame:
        now = heads.groupBy("key").agg(F.count(F.lit(1)).alias("now"), F.sum("n").alias("mass"), F.first("was").alias("was")).where(least)
        return heads.drop("was").join(now.select("key", F.col("now").alias("was"), _blocks("now", "mass").alias("blocks")), "key")

    for j in range(KEYS):
        active = left.select("cid", "n", "s", F.get("keys", F.lit(j))["token"].alias("key"), F.lit(0).cast("long").alias("was"))
        active, first = written(counted(active, "now > 1"), "active"), len(moves)
        while active.limit(1).count():
            placed = active.withColumn("block", F.pmod(F.xxhash64("cid", "was"), F.col("blocks")))
            many = placed.groupBy("key", "block").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
            met = placed.join(many.drop("m"), ["key", "block"]).join(sets, "cid")
            heads = written(met.groupBy("key", "block").applyInArrow(_at(_settle, percent), _SETTLED), "heads")
            moves.append(heads.where("cid <> head").select("cid", "head"))
            # All of the key's documents but the followers; those that met nobody are heads, too.
            rest = placed.where("blocks > 1").join(moves[-1], "cid", "left_anti").select("cid", "n", "s", "key", "was")
            active = written(counted(rest, "now > 1 AND 2 * now <= was"), "active")
        for moved in moves[first:]:
            left = left.join(moved, "cid", "left_anti")
        left = written(left, "left")
        now = left.count()
        if (before - now) * ENOUGH < before:
            break
        before = now
    # A follower's head may follow another one later; a head has few direct followers in a round.
    final = moves.pop() if moves else None
    while moves:
        upper = final.select(F.col("cid").alias("head"), F.col("head").alias("top"))
        final = written(moves.pop().join(upper, "head", "left").select("cid", F.coalesce("top", "head").alias("head")).unionByName(final), "followers")
    if final is None:
        return docs.select("cid", F.col("cid").alias("label"))
    return written(docs.select("cid").join(final, "cid", "left").select("cid", F.coalesce("head", "cid").alias("label")), "labels")


def _tied(docs: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of labels for all pairs of documents that link but have different labels."""
    followed = labels.where("cid <> label").select(F.col("label").alias("cid"), F.lit(True).alias("followed")).distinct()
    docs = docs.join(labels, "cid").join(followed, "cid", "left")
    blocks = _blocks("keys[0].df", "0")
    block = F.pmod(F.xxhash64("cid"), blocks)
    alone = (F.col("cid") == F.col("label")) & F.col("followed").isNull()
    deficit = F.least(F.expr(f"(n - s) * {100 * CLASSES // 2} div (n * {max(1, 100 - percent)})"), F.lit(CLASSES))
    group = F.xxhash64(F.get("keys", F.lit(0))["token"], F.when(alone, F.when(blocks > 1, deficit)), F.when(~alone, F.col("label")), block)
    # home: documents of one home have met already.
    docs = docs.select("cid", "n", "s", "prefix", "label", group.alias("g"), F.when(~alone, F.col("label")).alias("only"), F.when(blocks == 1, F.get("keys", F.lit(0))["token"]).alias("home"))
    docs = written(docs, "grouped")

    matrix = docs.select("g", "only", "home", "n", "s", F.explode("prefix").alias("token")).groupBy("token", "g", "only", "home").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("s").alias("most"))
    matrix = written(matrix, "matrix")
    by_label = matrix.groupBy("token", "only").agg(F.count(F.lit(1)).alias("c"), F.min("home").alias("home"), F.max("home").alias("home2"), F.count("home").alias("homes"))
    tokens = by_label.groupBy("token").agg(F.sum("c").alias("c"), F.max(F.when(F.col("only").isNotNull(), F.struct("c", "only"))).alias("top"), F.min("home").alias("home"), F.max("home2").alias("home2"), F.sum("homes").alias("homes"))
    tokens = tokens.where("c > 1 AND (top IS NULL OR top.c < c) AND NOT (homes = c AND home = home2)").select("token", F.col("top.only").alias("major"))
    live = written(matrix.join(tokens, "token").withColumn("asks", ~F.col("only").eqNullSafe(F.col("major")) | F.col("only").isNull()), "live")
    other = live.select("token", *[F.col(c).alias(f"{c}2") for c in ("g", "only", "home", "lo", "hi", "most", "asks")])
    reach = f"hi * 100 >= {percent} * lo2 AND hi2 * 100 >= {percent} * lo AND {100 + percent} * least(most, most2) >= {percent} * (lo + lo2)"
    apart = "(home IS NULL OR home2 IS NULL OR home <> home2) AND (only IS NULL OR only2 IS NULL OR only <> only2)"
    met = live.where("asks").join(other, "token").where(f"g <> g2 AND (g < g2 OR NOT asks2) AND {apart} AND {reach}").select(F.col("g"), F.col("g2").alias("h"))
    own = docs.groupBy("g", "only", "home").agg(F.count(F.lit(1)).alias("m"))
    itself = own.where("only IS NULL AND home IS NULL AND m > 1").select("g", F.col("g").alias("h"))
    met = written(met.distinct().unionByName(itself), "met")

    asked = met.join(own.select("g", "m"), "g").groupBy(F.col("h").alias("g")).agg(F.sum("m").alias("q"))
    sizes = written(asked.select("g", F.expr(f"greatest(1, (q + {CHUNK - 1}) div {CHUNK})").cast("int").alias("chunks")), "opened")
    members = docs.select("cid", "label", "g").join(sizes, "g").select("cid", "label", "g", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"))
    queries = met.join(sizes.withColumnRenamed("g", "h"), "h").join(docs.select("cid", "label", "g"), "g")
    queries = queries.select("cid", "label", F.col("h").alias("g"), F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("role"))
    return members.unionByName(queries).join(sets, "cid").groupBy("g", "chunk").applyInArrow(_at(_ties, percent), _TIES)


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, detail: bool = False) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id.

    Two texts link when 100 * intersection >= percent * union of their k-word shingle sets;
    component_id is the smallest id reachable by links. Texts without words (null too) link
    with nothing and are their own component. Rows with equal sets are one class; rows that
    repeat an id are kept as rows. Null ids stay null and are passed over as component ids;
    a component of null ids only has a null one. An empty table gives an empty result. Other
    columns are not read. With `detail` also text_print (xxhash64 of the text) and component
    (a binary name that only the rows of one component have; null for texts without words).
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    workers_ready(df.sparkSession)
    edge = int(min(0.49, 1.75 * (1 - percent / 100) + 0.005) * 2**64)
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.select("id", F.xxhash64("text").alias("print"), "text")
    rows = written(rows.mapInArrow(partial(_sketches, k=k, percent=percent, edge=edge), _SKETCH), "sketches")
    classes = rows.where("n > 0").groupBy("cid").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("low").alias("low"), F.first("sketch").alias("sketch"))
    # A number is unique in the table that was written, whatever tasks ran again before.
    classes = written(classes.withColumn("num", F.monotonically_increasing_id()), "classes")

    near = _rare_first(classes, percent, edge).select("cid")
    wanted = written(near.join(classes.select("cid", "id"), "cid").select("id").distinct(), "wanted")
    sets = texts.join(wanted.where("id IS NOT NULL"), "id", "left_semi")
    if wanted.where("id IS NULL").limit(1).count():
        sets = sets.unionByName(texts.where("id IS NULL"))
    sets = written(sets.mapInArrow(partial(_whole_sets, k=k), _SET).where("size(tokens) > 0").dropDuplicates(["cid"]).withColumn("num", F.monotonically_increasing_id()), "sets")

    whole = sets.select("num", "cid", F.size("tokens").cast("long").alias("n"), F.size("tokens").cast("long").alias("low"), F.col("tokens").alias("sketch"))
    docs, sets = written(_rare_first(whole, percent, None), "candidates"), sets.drop("num")
    labels = _settled(docs, sets, percent)
    links = written(_tied(docs, labels, sets, percent), "links")

    by_label = labels.join(classes.select("cid", "id"), "cid").groupBy("label").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))
    found = connected_components(links, by_label.select(F.col("label").alias("node"), F.col("id").alias("label")))
    found = by_label.join(found.select(F.col("node").alias("label"), F.col("label").alias("least"), F.col("head")), "label", "left")
    found = written(found.select("label", F.coalesce("least", "id").alias("least"), F.coalesce("head", "label").alias("component"), "weight"), "components")
    final = classes.select("cid", "id", "rows").join(salted_lookup(labels, found, "label", "weight", ["cid"]).drop("label"), "cid", "left")
    final = written(final.select("cid", F.coalesce("least", "id").alias("least"), F.coalesce("component", "cid").alias("component"), F.col("rows").alias("weight")), "labelled")
    out = salted_lookup(rows.select("id", "print", F.when(F.col("n") > 0, F.col("cid")).alias("cid"), "n"), final, "cid", "weight", ["id", "print"])
    own = F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least"))
    named = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id")]
    return out.select(*named, *([F.col("print").alias("text_print"), "component"] if detail else []))


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), k=3, percent=90)
