"""Main text of web pages: repeats across the pages of a host, by a suffix array.

1. Each page becomes blocks of text with marks (html_blocks), where it is read; only those
   travel.
2. The pages of a host meet in groups of about GROUP pages: a host of more is dealt out by
   the hash of its pages. How many groups is a function of a table of page counts with
   BUCKETS rows at most, which alone is broadcast.
3. In a group the token streams of all pages are concatenated and their suffixes sorted to
   the depth of LEAST tokens by prefix doubling. Neighbours that agree to that depth start
   the same run; every longer repeat is a chain of such runs. A run found on LEAST_PAGES
   distinct pages covers its tokens; pages with the same text are one.
4. Where a host has several groups and pages without an article (open ones), each group tells
   its runs once, with the least and greatest digest of the pages that have them; runs whose
   digests differ over all groups of the host are repeats too, and go back to the groups that
   have them in open pages. Runs travel as 64-bit hashes. The pages of such hosts are parsed
   again for it, so nothing is kept on disk.
5. Blocks in the page's article stay whole, whatever repeats them: mirrored articles and
   passages that many articles share are main text. Furniture goes. Of the other blocks of a
   page without an article, covered tokens go and unique runs stay.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import written
from riskloom.llm.html_blocks import ARTICLE, FURNITURE, blocks_of
from riskloom.llm.shingles import mix, words_of

GROUP, BUCKETS = 512, 1 << 20
LEAST, LEAST_PAGES = 8, 2


def page_blocks(page: str | None) -> tuple[str, str]:
    """(texts joined by newlines, marks as digits): a block's text holds no newline."""
    found = blocks_of(page or "")
    return "\n".join(t for _, t in found), "".join(str(m) for m, _ in found)


def suffix_order(tokens: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of concatenated streams to a depth, and each suffix's rank. `ends`
    holds for each position the end of its stream, which no suffix passes: a stream that is
    over sorts before every token. Suffixes of equal rank agree in `depth` tokens."""
    _, rank = np.unique(tokens, return_inverse=True)
    rank, h = rank.astype(np.int64) + 1, 1
    at = np.arange(len(tokens))
    while h < depth:
        step = min(h, depth - h)
        follow = np.where(at + step < ends, rank[np.minimum(at + step, len(tokens) - 1)], 0)
        _, rank = np.unique(rank * (len(tokens) + 2) + follow, return_inverse=True)
        rank, h = rank.astype(np.int64) + 1, h + step
    return np.argsort(rank, kind="stable"), rank


def runs_of(tokens: np.ndarray, page: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all runs of `least` tokens within a page, in the order of their suffixes,
    and the number of the run at each."""
    if len(tokens) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.searchsorted(page, page, "right")
    order, rank = suffix_order(tokens, ends, least)
    order = order[ends[order] - order >= least]  # runs that end within their page
    if not len(order):
        return order, order
    new = np.concatenate(([True], rank[order][1:] != rank[order][:-1]))
    return order, np.cumsum(new) - 1


def run_hashes(tokens: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """A hash of the `least` tokens from each start on."""
    total = np.zeros(len(starts), np.uint64)
    for i in range(least):
        total = mix(total + tokens[starts + i] * np.uint64(((2 * i + 3) * 0xC2B2AE3D27D4EB4F) & (2**64 - 1) | 1))
    return total.view(np.int64)


def group_runs(bodies: list[str], marks: list[str], digests: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, least and greatest digest of its pages, whether an open page has it) of each
    distinct run of a group."""
    words, page = words_of(pa.array(bodies, pa.large_string()))
    starts, run = runs_of(words, page, least)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    own = page[starts]
    wanted = np.logical_or.reduceat(np.array([is_open(m) for m in marks], bool)[own], first)
    return run_hashes(words, starts[first], least), np.minimum.reduceat(digests[own], first), np.maximum.reduceat(digests[own], first), wanted


def covered(tokens: np.ndarray, page: np.ndarray, content: np.ndarray, least: int = LEAST, least_pages: int = LEAST_PAGES, known: np.ndarray | None = None) -> np.ndarray:
    """Whether each token lies in a run of `least` tokens that `least_pages` distinct contents
    have. page: the page of each token, ascending; content: that page's content number; known:
    hashes of further runs that cover their tokens."""
    n = len(tokens)
    order, run = runs_of(tokens, page, least)
    if not len(order):
        return np.zeros(n, bool)
    pairs = np.unique(run * (int(content.max()) + 1) + content[order])
    pages = np.bincount(pairs // (int(content.max()) + 1), minlength=run[-1] + 1)
    repeated = pages[run] >= least_pages
    if known is not None and len(known):
        repeated |= np.isin(run_hashes(tokens, order, least), known)
    starts = order[repeated]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + least, -1)
    return np.cumsum(edge)[:n] > 0


def is_open(mark: str) -> bool:
    """Whether a page's marks hold no article, but other blocks than furniture."""
    return bool(mark) and FURNITURE < int(max(mark)) < ARTICLE


def main_texts(bodies: list[str], marks: list[str], least: int = LEAST, least_pages: int = LEAST_PAGES, known: np.ndarray | None = None) -> list[str]:
    """The main text of each page of a group. known: hashes of runs that other groups repeat."""
    words, page = words_of(pa.array(bodies, pa.large_string()))
    content = np.unique(np.array(bodies, object), return_inverse=True)[1] if bodies else np.zeros(0, int)
    gone = covered(words, page, content[page], least, least_pages, known) if len(words) else np.zeros(0, bool)
    first = np.searchsorted(page, np.arange(len(bodies) + 1))
    out = []
    for i, (body, mark) in enumerate(zip(bodies, marks, strict=True)):
        blocks = body.split("\n") if mark else []
        top = max(map(int, mark), default=FURNITURE)
        if top == ARTICLE:
            out.append(" ".join(b for b, m in zip(blocks, mark, strict=True) if int(m) == ARTICLE))
            continue
        at, kept = int(first[i]), []
        for b, m in zip(blocks, mark, strict=True):
            own = b.split(" ")
            if FURNITURE < int(m) == top:
                kept += [w for w, g in zip(own, gone[at : at + len(own)], strict=True) if not g]
            at += len(own)
        out.append(" ".join(kept))
    return out


def host_of(url):
    """The host of a URL, in small letters; null where there is none."""
    host = F.lower(F.regexp_extract(url.cast("string"), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host)


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group: int = GROUP) -> DataFrame:
    """(id, url, text, n_chars) of every row.

    A null or empty page has an empty text. Pages without a host share no boilerplate and are
    dealt out singly. Repeated rows each give a row and count as one page. An empty table
    gives an empty result; other columns are not read."""
    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = dict(rows.dtypes)

    def parsed(batches):
        for batch in batches:
            found = [page_blocks(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array([b for b, _ in found], pa.string()), pa.array([m for _, m in found], pa.string())], ["id", "url", "body", "marks"])

    bucket = F.pmod(F.xxhash64(host_of(F.col("url"))), F.lit(BUCKETS)).alias("bucket")
    parts = rows.where(host_of(F.col("url")).isNotNull()).groupBy(bucket).agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("parts"))
    def dealt(pages: DataFrame) -> DataFrame:
        blocks = pages.select("id", "url", "html").mapInArrow(parsed, f"id {kinds['id']}, url {kinds['url']}, body string, marks string")
        blocks = blocks.withColumn("host", host_of(F.col("url"))).withColumn("bucket", bucket).join(F.broadcast(parts), "bucket", "left")
        part = F.when(F.col("host").isNull(), F.xxhash64("id", "body")).otherwise(F.pmod(F.xxhash64("id", "body"), F.col("parts")))
        return blocks.withColumn("part", part).drop("bucket", "parts")

    def runs(pages: pd.DataFrame) -> pd.DataFrame:
        run, low, high, wanted = group_runs(list(pages["body"]), list(pages["marks"]), pages["digest"].to_numpy(np.int64))
        return pd.DataFrame({"host": pages["host"].iloc[0], "part": pages["part"].iloc[0], "run": run, "low": low, "high": high, "wanted": wanted})

    def texts(pages: pd.DataFrame, known: pd.DataFrame | None = None) -> pd.DataFrame:
        found = main_texts(list(pages["body"]), list(pages["marks"]), known=None if known is None else known["run"].to_numpy(np.int64))
        return pd.DataFrame({"id": pages["id"], "url": pages["url"], "text": found, "n_chars": [len(t) for t in found]})

    def alone(pages: pd.DataFrame) -> pd.DataFrame:
        return texts(pages)

    names = f"id {kinds['id']}, url {kinds['url']}, text string, n_chars bigint"
    groups = dealt(rows).groupBy("host", "part")
    # Marks are digits: an article's is the greatest, and furniture's alone is no open page's.
    unsettled = ~F.contains("marks", F.lit(str(ARTICLE))) & (F.translate("marks", str(FURNITURE), "") != "")
    large = rows.withColumn("host", host_of(F.col("url"))).withColumn("bucket", bucket).join(F.broadcast(parts.where("parts > 1")), "bucket", "left_semi")
    hosts = written(dealt(large).where(unsettled).select("host").distinct(), "hosts")
    if not hosts.limit(1).count():
        out = groups.applyInPandas(alone, names)
    else:
        told = dealt(large.join(hosts, "host", "left_semi")).withColumn("digest", F.xxhash64("body")).groupBy("host", "part")
        told = written(told.applyInPandas(runs, "host string, part bigint, run bigint, low bigint, high bigint, wanted boolean"), "runs")
        common = told.groupBy("host", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("groups")).where("low <> high AND groups > 1").select("host", "run")
        known = told.where("wanted").select("host", "part", "run").join(common, ["host", "run"])
        out = groups.cogroup(known.groupBy("host", "part")).applyInPandas(texts, names)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def op13_html_extraction(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: SQL for the template of the given pages: one article a page; blocks end in block tags.
SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '</?(h1|p|br|li|ul|div)>', ' ', 'g'), '<[^>]*>', '', 'g') AS body FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(replace(body, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', '''') AS body FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(body, '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""
