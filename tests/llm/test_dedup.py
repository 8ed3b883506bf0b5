import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import components, exact_dedup, jaccard_join, line_dedup, shingles


def collected(df):
    return Counter(tuple(r) for r in df.collect())


def test_exact_groups(messy, pairs):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups: dict[str, list] = {}
    for i, t in pairs:
        groups.setdefault(norm(t), []).append(i)
    want = Counter()
    for i, t in pairs:
        g = groups[norm(t)]
        ids = [x for x in g if x is not None]
        keep = min(ids) if ids else None
        want[i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    assert collected(exact_dedup.duplicate_groups(messy)) == want
    assert collected(exact_dedup.duplicate_groups(messy, salts=1)) == want


def test_many_null_ids_are_spread(spark):
    """10,000 rows without id and with one text: the lookup's keys share them out."""
    df = spark.range(10_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    got = exact_dedup.duplicate_groups(df)
    assert got.groupBy("keep_id", "group_size", "kept").count().collect()[0]["count"] == 10_000
    salts = df.select(F.pmod(F.monotonically_increasing_id(), F.lit(exact_dedup.SPREAD)).alias("s")).groupBy("s").count()
    assert salts.count() == exact_dedup.SPREAD and salts.agg(F.max("count")).first()[0] < 2 * 10_000 / exact_dedup.SPREAD


def test_exact_rows(messy, pairs, empty):
    kept = exact_dedup.drop_duplicates(messy)
    assert kept.columns == messy.columns
    rows = kept.collect()
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in rows]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in pairs})
    assert sorted(r.doc_id for r in rows if r.text and r.doc_id in (4, 6, 7)) == [4]
    assert exact_dedup.drop_duplicates(empty).count() == 0 == exact_dedup.duplicate_groups(empty).count()


def lines_by_hand(pairs, least, chars=1):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    counts = Counter(k for _, t in pairs for k in {key(x) for x in (t or "").split("\n")})
    out = Counter()
    for i, t in pairs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= chars and counts[key(x)] >= least)]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def test_lines(messy, pairs, empty):
    for least in (2, 10, 13):
        assert collected(line_dedup.drop_common_lines(messy, min_documents=least)) == lines_by_hand(pairs, least)
    assert collected(line_dedup.drop_common_lines(messy, min_chars=12, salts=2)) == lines_by_hand(pairs, 10, 12)
    assert line_dedup.drop_common_lines(empty).count() == 0


def by_hand(pairs, k, percent):
    def words(t):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x20\x09-\x0D]+", lower)

    sets = []
    for _, t in pairs:
        w = words(t)
        sets.append(frozenset(zip(*[w[j:] for j in range(k)], strict=False)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset())
    head = list(range(len(pairs)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in itertools.combinations(range(len(pairs)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            head[find(a)] = find(b)
    out = Counter()
    for a, (i, _) in enumerate(pairs):
        ids = [pairs[b][0] for b in range(len(pairs)) if find(b) == find(a) and pairs[b][0] is not None]
        out[i, len(sets[a]), min(ids) if ids else None] += 1
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 100)])
def test_jaccard_on_messy_rows(messy, pairs, k, percent):
    assert collected(jaccard_join.jaccard_components(messy, k=k, percent=percent)) == by_hand(pairs, k, percent)


def test_jaccard_on_a_large_family(spark, monkeypatch):
    """Chains, a family of near copies over several blocks and chunks, shared passages."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "CHUNK", 8)
    monkeypatch.setattr(jaccard_join, "HOT_KEYS", 50)
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 500)
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    base = [word() for _ in range(80)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
            w[rng.randrange(80)] = word()
        texts.append(" ".join(w))
    w = list(base)
    for i in range(20):  # a chain: each text changes one more word
        w[i * 3] = word()
        texts.append(" ".join(w))
    passage = [word() for _ in range(30)]
    texts += [" ".join([word() for _ in range(15)] + passage + [word() for _ in range(10)]) for _ in range(40)]
    texts += [" ".join(passage[:9]) for _ in range(3)]
    pairs = list(enumerate(texts))
    rng.shuffle(pairs)
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    for k, percent in ((3, 90), (5, 80), (2, 60)):
        assert collected(jaccard_join.jaccard_components(df, k=k, percent=percent)) == by_hand(pairs, k, percent), (k, percent)


def test_links_of_a_family_of_near_copies_grow_in_proportion(spark, monkeypatch):
    """Every table that the join writes holds a row a document at most, whatever the family's size."""
    made: dict[str, int] = {}
    plain = jaccard_join.written

    def counted(df, name, *more):
        out = plain(df, name, *more)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(jaccard_join, "written", counted)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "CHUNK", 16)
    rng = random.Random(3)
    base, found = [f"w{i}" for i in range(200)], {}
    for n in (300, 1200):
        texts = []
        for i in range(n):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                w[rng.randrange(200)] = f"v{rng.randrange(10**7)}"
            texts.append((i, " ".join(w)))
        made.clear()
        got = jaccard_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string"), k=5, percent=80).collect()
        assert len(got) == n and {r.component_id for r in got} == {0}
        found[n] = dict(made)
    for name, rows in found[1200].items():
        assert rows <= max(6 * found[300][name], 300), (name, found)
    assert found[1200]["met"] + found[1200]["links"] < 300, found


def test_jaccard_bounds(empty):
    assert jaccard_join.jaccard_components(empty).count() == 0
    with pytest.raises(ValueError, match="percent"):
        jaccard_join.jaccard_components(empty, percent=50)
    assert [jaccard_join.prefix_length(n, 90) for n in (1, 9, 10, 11, 100)] == [1, 1, 2, 2, 11]


def test_shingles_do_not_depend_on_slices(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "B", "long" * 30, "é"]) for _ in range(rng.randrange(60))) for _ in range(50)] + [None, "", "x" * 500]
    with np.errstate(over="ignore"):
        whole = [s.tolist() for s in shingles.sets_of(pa.array(texts), 3)]
        monkeypatch.setattr(shingles, "SLICE", 64)
        shingles._POWERS.clear()
        assert [s.tolist() for s in shingles.sets_of(pa.array(texts), 3)] == whole
        shingles._POWERS.clear()
        assert [s.tolist() for s in shingles.sets_of(pa.array(["-", *texts])[1:], 3)] == whole


def test_components_of_a_path(spark):
    n = 40
    links = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(n - 1)] + [("x", "y")], "a string, b string")
    labels = spark.createDataFrame([(f"{i:03d}", n - i) for i in range(n)] + [("x", None), ("y", None)], "node string, label long")
    got = {r.node: r.label for r in components.connected_components(links, labels).collect()}
    assert {got[f"{i:03d}"] for i in range(n)} == {1} and got["x"] is None
    assert components.connected_components(links.limit(0), labels.where(F.lit(False))).count() == 0


def test_components_of_a_long_shuffled_path(spark):
    n = 1000
    labels = list(range(n))
    random.Random(5).shuffle(labels)
    nodes = spark.createDataFrame(list(enumerate(labels)), "node long, label long")
    links = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long")
    got = components.connected_components(links, nodes).collect()
    assert len(got) == n and {r.label for r in got} == {0}


def test_a_chain_of_revisions_is_one_component(spark):
    """Each text links with its neighbours only: 16 of 18 shingles are shared, then 15 of 19."""
    n, width = 400, 19
    ids = list(range(n))
    random.Random(6).shuffle(ids)
    texts = [(ids[i], " ".join(f"w{j}" for j in range(i, i + width))) for i in range(n)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string"), k=3, percent=80).collect()
    assert len(got) == n and {r.component_id for r in got} == {0}


def test_spotsigs_pairs_equal_brute_force_and_few_signatures_move(spark):
    """Pairs by unique signatures, by frequent ones and at the threshold itself; signatures of
    one set are in no table that is written."""
    from riskloom.llm import spotsigs

    rng = random.Random(3)
    sets = {i: set(rng.sample(range(40), 12)) | {1000 + i} for i in range(60)}
    for i in range(60, 90):
        base = sets[i - 60]
        sets[i] = (base - set(rng.sample(sorted(base), rng.randrange(3)))) | {2000 + i} if i % 3 else set(base) | {3000 + j for j in range(i % 4)}
    rows = [(bytes([i]), i, sorted(s), len(s), 1) for i, s in sets.items()]
    classes = spark.createDataFrame(rows, "class binary, id bigint, s array<bigint>, n int, rows bigint")
    kept, plain = [], spotsigs.written
    spotsigs.written = lambda df, name, *a: kept.append((name, plain(df, name, *a))) or kept[-1][1]
    try:
        for threshold in (0.6, 0.8, 0.9):
            got = {(min(a, b), max(a, b)) for a, b in ((r.class_a[0], r.class_b[0]) for r in spotsigs.similar_classes(classes, threshold).collect())}
            want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}
            assert got == want and want
    finally:
        spotsigs.written = plain
    assert all(df.where("df = 1").count() == 0 for name, df in kept if name == "counts") and "counts" in [name for name, _ in kept]
