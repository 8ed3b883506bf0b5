"""SpotSigs fingerprints in DataFrame operations only.

A signature is a common-word anchor with the next CHAIN content words after it (anchors in
between are skipped). One regular-expression pass over the normalised text writes each
anchor's chain in front of it, so the work is linear in the text. A document's fingerprint is
the sorted set of its signature hashes; a signature that occurs 2, 4, 8 ... times
adds one more hash each, so texts that repeat a few sentences keep their weight. Where anchors
are few (other languages, lists) words stand in for them, decided from the words around: a word
with no anchor among the FEW words before and the FEW after it is one, with the next two words,
and so is an anchor before FEW more anchors. So an edit changes only signatures near it. Texts
without any chain (a few words) get every word as an anchor; without CHAIN + 1 words in a row
they get one signature, the whole text. Only the empty text has an empty fingerprint.

similar_pairs compares a corpus: sets are partitioned by length so that sets that can reach
the threshold lie in the same or in neighbouring partitions, meet there through one of their
rarest signatures, and are pruned by length before their Jaccard similarity is counted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import documents, salted_lookup, text_of, written
from riskloom.llm.ordering import next_keys

# The anchors: common words of four languages.
ANCHORS = (
    "the of and to in is that for it was on are as with at be this from by or an have not which you but they his her has had "
    "der die und den das von zu mit sich des auf nicht ein eine dem im ist als auch es er wird aus bei "
    "de la le et les en un une du que dans pour qui sur par pas au plus ne se sont est "
    "el y los del las por con para su al lo como no más o una"
).split()
CHAIN = 2
FEW = 10
#: Sets that meet under one signature at once; a frequent signature is cut into blocks.
BLOCK = 256
BUCKET_BITS = 6


def _trie(words: list[str]) -> str:
    """A regular expression for the words that shares their beginnings."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    end = "" in heads
    parts = [head + _trie(rest) for head, rest in heads.items() if head]
    if not parts:
        return ""
    return "(?:" + "|".join(parts) + ")" + "?" * end


_ANCHOR = _trie(ANCHORS)
_SKIP = rf"(?: {_ANCHOR}(?= ))*+"
_NEXT = "(?= ([^ ]+) ([^ ]+) )"
_RUN = rf" ({_ANCHOR})(?=(?: {_ANCHOR}(?= )){{{FEW}}}){_NEXT}"
# A spot takes the FEW content words after it along, so that none of them becomes an anchor.
_SPOT = rf" ({_ANCHOR})(?={_SKIP} ([^ ]+){_SKIP} ([^ ]+) )(?: (?!{_ANCHOR} )[^ ]++){{0,{FEW}}}+"
_GAP = rf" (?!{_ANCHOR} )([^ ]++)(?! (?:[^ ]++ ){{0,{FEW - 1}}}?{_ANCHOR} ){_NEXT}"
_LOCAL = "|".join((_RUN, _SPOT, _GAP))
_ANY = rf" ([^ ]+){_NEXT}"
# Groups of the alternatives that did not match are empty.
_MARKED = {_LOCAL: "\u0002$1$4$7 $2$5$8 $3$6$9\u0003", _ANY: "\u0002$1 $2 $3\u0003"}


def _chains(norm: Column, pattern: str) -> Column:
    marked = F.regexp_replace(norm, pattern, _MARKED[pattern])
    pieces = F.split(marked, "\u0002", -1)
    return F.transform(F.slice(pieces, F.lit(2), F.lit(1 << 30)), lambda x: F.xxhash64(F.substring_index(x, "\u0003", 1)))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once although `use` names it often."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def _with_levels(ordered: Column) -> Column:
    """The distinct values of a sorted array; one that occurs c times comes with its hashes for
    the levels 1 to floor(log2(c))."""
    first = lambda xs: F.filter(F.sequence(F.lit(0), F.size(xs) - 1), lambda i: (i == 0) | (F.get(xs, i) != F.get(xs, i - 1)))

    def hashes(xs, at, times):
        levels = F.filter(F.sequence(F.lit(0), F.floor(F.log2(times.cast("double"))).cast("int")), lambda k: k > 0)
        tagged = F.transform(levels, lambda k: F.xxhash64(F.get(xs, at), k))
        return F.when(times < 2, F.array(F.get(xs, at))).otherwise(F.concat(F.array(F.get(xs, at)), tagged))

    def of(xs):
        return _let(first(xs), lambda starts: F.flatten(F.transform(starts, lambda at, j: hashes(xs, at, F.coalesce(F.get(starts, j + 1), F.size(xs)) - at))))

    return F.when(F.size(ordered) > 0, _let(ordered, of)).otherwise(F.array().cast("array<bigint>"))


def normalised(text: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the sorted signature hashes of the (non-null) text column as column `out`."""
    norm, spots, words = f"_{out}_norm", f"_{out}_spots", f"_{out}_words"
    df = df.withColumn(norm, normalised(F.col(text)))
    df = df.withColumn(words, F.length(norm) - F.length(F.translate(norm, " ", "")) - 1)
    df = df.withColumn(spots, _chains(F.col(norm), _LOCAL))
    some = F.when(F.size(spots) > 0, F.col(spots)).otherwise(_chains(F.col(norm), _ANY))
    df = df.withColumn(spots, F.sort_array(some)).withColumn(out, F.sort_array(_with_levels(F.col(spots))))
    whole = F.when(F.length(text) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.when(F.col(words) > 0, F.col(norm)).otherwise(F.col(text)))))
    return df.withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(whole)).drop(norm, spots, words)


def as_text(signatures: Column) -> Column:
    return F.array_join(signatures.cast("array<string>"), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets; two empty ones are alike."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, signatures (sorted array of longs). A null text counts as
    empty; rows that repeat an id get a row each; ids may be null; an empty table gives an
    empty result; other columns are not read."""
    return with_signatures(df.select(id_col, text_of(text_col).alias("_t")), "_t", "signatures").drop("_t")


def fingerprint_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """members(id_col, class) and classes(class, id, s, n): rows with equal fingerprints are one
    class, named by a digest and represented by its smallest id (null if all are)."""
    found = fingerprints(df, id_col, text_col).select(id_col, "signatures", F.unhex(F.sha2(as_text(F.col("signatures")), 256)).alias("class"))
    found = written(found, "fingerprints")
    classes = found.groupBy("class").agg(F.min(id_col).alias("id"), F.first("signatures").alias("s"), F.count(F.lit(1)).alias("rows"))
    return found.select(id_col, "class"), written(classes.select("class", "id", "s", F.size("s").alias("n"), "rows"), "classes")


def similar_classes(classes: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (class_a, class_b, likeness) of classes whose likeness is at least `threshold`; the
    shorter set first. Empty sets link with nothing. Every pair is found, through the first of
    its signatures in the order of their document counts."""
    sets = classes.where("n > 0")
    counts = written(sets.select(F.explode("s").alias("head")).groupBy("head").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "counts")
    keep = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    part = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold)).cast("int")
    # A signature of one set only meets nothing and comes first in its set's order: such are not
    # moved again, but counted off the prefix.
    ranked = sets.select("class", "n", F.explode("s").alias("head")).join(counts, "head").groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct("df", "head"))).alias("heads"))
    left_over = keep - (F.col("n") - F.size("heads"))
    keyed = ranked.where(left_over > 0).select("class", "n", part.alias("part"), (F.col("n") - F.size("heads")).alias("ahead"), F.posexplode(F.slice("heads", F.lit(1), left_over)).alias("at", "x"))
    keyed = keyed.select("class", "n", "part", "x.head", "x.df", (F.col("n") - F.col("ahead") - F.col("at")).alias("rest"))
    blocks = F.expr(f"(df + {BLOCK - 1}) div {BLOCK}").cast("int")
    keyed = written(keyed.withColumn("blocks", blocks), "keyed")
    # Both sides of a signature are cut: a set lies in one block of its side and goes to each
    # block of the other side, so a task's key holds about BLOCK sets of either side.
    own, other = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    right = keyed.select(F.col("class").alias("class_b"), F.col("n").alias("nb"), F.col("rest").alias("rb"), "head", "part", own.alias("block"), other.alias("side"))
    left = keyed.select(F.col("class").alias("class_a"), F.col("n").alias("na"), F.col("rest").alias("ra"), "head", F.explode(F.array("part", F.col("part") + 1)).alias("part"), own.alias("side"), "blocks")
    left = left.select("class_a", "na", "ra", "head", "part", "side", other.alias("block"))
    met = left.join(right, ["part", "head", "block", "side"]).where((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("class_a") < F.col("class_b"))))
    # At the first signature that two sets share, no more than the rest of either can be common.
    enough = F.least("ra", "rb") >= (F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9
    met = met.where((F.col("na") >= F.col("nb") * threshold - 1e-9) & enough).select("class_a", "class_b").distinct()
    whole = sets.select("class", "s")
    both = met.join(whole.select(F.col("class").alias("class_a"), F.col("s").alias("sa")), "class_a").join(whole.select(F.col("class").alias("class_b"), F.col("s").alias("sb")), "class_b")
    return both.select("class_a", "class_b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= threshold)


def similar_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """Pairs (a, b, likeness) of class representatives whose likeness is at least `threshold`.
    Rows with equal fingerprints are one class, represented by its smallest id; membership is
    in fingerprint_classes. Empty texts link with nothing."""
    _, classes = fingerprint_classes(df, id_col, text_col)
    names = classes.select("class", "id")
    found = similar_classes(classes, threshold).join(names.select(F.col("class").alias("class_a"), F.col("id").alias("a")), "class_a").join(names.select(F.col("class").alias("class_b"), F.col("id").alias("b")), "class_b")
    return found.select("a", "b", "likeness")


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row per input row: id_col, class_id (the smallest id with an equal fingerprint),
    n_links (classes whose likeness with its own is at least `threshold`)."""
    members, classes = fingerprint_classes(df, id_col, text_col)
    found = written(similar_classes(classes, threshold), "pairs")
    links = found.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    named = classes.join(links, "class", "left").select("class", F.col("id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "rows")
    return salted_lookup(members, written(named, "named"), "class", "rows", [id_col]).drop("class")


def _nameless(text: Column) -> Column:
    """A bucket below those of all ids, in the order of the texts: their first 7 bytes."""
    head = F.rpad(F.hex(F.substring(text.cast("binary"), 1, 7)), 14, "0")
    return F.conv(head, 16, 10).cast("long") - F.lit(1 << 62)


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """df(id, text) with signatures, next_text and next_signatures of the next row by ascending
    id (ties by text, null ids first; after the last row comes the first). Rows are dealt by the
    high bits of their ids, so neighbours lie in one partition and texts move once; only the
    first row of each bucket is sent to the bucket before. Rows without an id are dealt by the
    first bytes of their texts."""
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("bucket", F.coalesce(F.shiftright(F.col("id").cast("long"), BUCKET_BITS), _nameless(F.col("text"))))
    order = Window.partitionBy("bucket").orderBy("id", "text")
    firsts = rows.withColumn("rank", F.row_number().over(order)).where("rank = 1").select(F.col("bucket").alias("next"), F.col("text").alias("first_text"))
    after = next_keys(rows.select(F.col("bucket").alias("key")).distinct())
    lowest = after.agg(F.min("key")).first()[0]
    after = after.select(F.col("key").alias("bucket"), F.coalesce("next", F.lit(lowest).cast("long")).alias("next"))
    firsts = with_signatures(after.join(firsts, "next"), "first_text", "first_signatures").drop("next")
    here = rows.withColumn("next_text", F.lead("text").over(order))
    here = with_signatures(here, "text", "signatures").withColumn("next_signatures", F.lead("signatures").over(order))
    return here.join(firsts, "bucket", "left").select(
        "id", "text", "signatures", F.coalesce("next_text", "first_text").alias("next_text"), F.coalesce("next_signatures", "first_signatures").alias("next_signatures")
    )


def spotsigs_similar(spark, sf_dir: str) -> DataFrame:
    return similar_documents(documents(spark, sf_dir))


def op2_spotsigs(spark, sf_dir: str) -> DataFrame:
    rows = with_next(documents(spark, sf_dir), "doc_id", "text")
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut)))
    rows = with_signatures(rows, "edited", "edited_signatures")
    return rows.select(
        F.col("id").alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("signatures")).alias("fingerprint"),
        as_text(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )
