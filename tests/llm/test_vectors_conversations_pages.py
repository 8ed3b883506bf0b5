"""Vector codes, conversation repair and page extraction against brute force."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from riskloom.llm import conversation_repair as cr
from riskloom.llm import html_extraction as hx
from riskloom.llm import vector_codes as vc
from riskloom.llm.html_blocks import blocks_of

CLASHING = ", raw string, key string, id string, code string, part int"


def coded_by_hand(rows):
    """rows: (id, vector, label)."""
    kept = [(i, [math.floor(4096 * np.float64(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    lengths = Counter(len(v) for _, v, _ in kept if v and len(v) % 8 == 0)
    if not lengths:
        return Counter()
    size = max(lengths, key=lambda n: (lengths[n], n))
    kept = [k for k in kept if len(k[1]) == size]
    w = size // 8
    books = [[v[p * w : (p + 1) * w] for _, v, _ in sorted(kept, key=lambda k: (k[0] is None, k[0] or 0, k[1]))[:16]] for p in range(8)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def looked(v):
        out = []
        for p in range(8):
            d = [dist(v[p * w : (p + 1) * w], e) for e in books[p]]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(6):
        groups = [[[] for _ in books[0]] for _ in range(8)]
        for _, v, _ in kept:
            for p, (e, _) in enumerate(looked(v)):
                groups[p][e].append(v[p * w : (p + 1) * w])
        books = [[[sum(c) // len(g) for c in zip(*g, strict=True)] if g else books[p][e] for e, g in enumerate(groups[p])] for p in range(8)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [(i, "".join(f"{e:02x}" for e, _ in looked(v)), sum(d for _, d in looked(v)), label) for i, v, label in kept]
    sums = Counter()
    for _, _, d, label in found:
        sums[label] += d
    return Counter((i, c, d, sums[label], sha) for i, c, d, label in found)


def vector_rows():
    rng = random.Random(5)
    vec = lambda n=16: [rng.gauss(0, 0.2) for _ in range(n)]
    rows = [(i, vec(), rng.choice([1, 1, 2, None])) for i in range(60)]
    same = vec()
    rows += [(100, same, 3), (101, same, 3), (100, same, 3), (None, vec(), None), (None, None, 4), (3, vec(), 1)]
    return rows + [(102, None, 1), (103, [math.nan] * 16, 1), (104, [math.inf] + [0.0] * 15, 1), (105, [None] + [0.0] * 15, 1), (106, [], 1), (107, vec(8), 1), (108, vec(12), 2), (109, [-1.0] * 16, 9)]


@pytest.mark.parametrize("count", [0, 5, 17, 80])
def test_codes_equal_brute_force(spark, count):
    rows = vector_rows()
    rows = rows[:count] if count < 80 else rows
    df = spark.createDataFrame([(*r, "a", "b", "c", "d", 1) for r in rows], "vec_id bigint, embedding array<float>, label int" + CLASHING).repartition(3)
    assert Counter(tuple(r) for r in vc.compressed(df).collect()) == coded_by_hand(rows)


def test_nearest_entry_and_its_filter():
    rng = np.random.default_rng(2)
    for scale in (1, 3, 500):
        entries, x = rng.integers(-scale, scale + 1, (16, 8)), rng.integers(-2 * scale, 2 * scale + 1, (4000, 8))
        index, error, measured = vc.nearest(x, vc.approximated(entries))
        full = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == full.argmin(axis=1)).all() and (error == full.min(axis=1)).all()
        assert scale == 1 or measured < 0.5 * full.size


def test_a_component_without_a_distance_stops_the_run(spark):
    with pytest.raises(Exception, match="a component passes"):
        vc.compressed(spark.createDataFrame([(1, [1e6] * 8, 1)], "vec_id bigint, embedding array<double>, label int"))


def cheapest(rows, most_insertions=4):
    """(cost, audit) by trying all edits."""
    out = []

    def go(i, said, cost, audit, left):
        if i == len(rows):
            if re.fullmatch(r"(s?(ua)+)?", said):
                out.append((cost, audit))
        else:
            initial, fault = rows[i]
            go(i + 1, said, cost + 4, audit + "D", left)
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if initial:
                    go(i + 1, said + initial, cost + more, audit + "K", left)
                for g in "ua":
                    go(i + 1, said + g, cost + more + 3, audit + "R", left)
        if left:
            for g in "ua":
                go(i, said + g, cost + 3, audit + "I", left - 1)

    go(0, "", 0, "", most_insertions)
    return min(out)


def test_parser_equals_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        rows = [(rng.choice(["s", "u", "a", "x", "", " "]), rng.choice([None, None, "blank", "duplicate", "truncated"])) for _ in range(rng.randrange(4))]
        cost, edits = cr.repair(rows)
        assert (cost, "".join(x for x, _ in edits)) == cheapest(rows)


def test_a_long_conversation_takes_linear_work():
    rng = random.Random(4)
    took = []
    for n in (20_000, 40_000):
        rows = [(rng.choice("suax"), rng.choice([None, "truncated", "blank"])) for _ in range(n)]
        begun = time.perf_counter()
        _, edits = cr.repair(rows)
        took.append(time.perf_counter() - begun)
        assert sum(x != "I" for x, _ in edits) == n
    assert took[1] < 4 * took[0]


def repaired_by_hand(rows):
    """rows: (conv_id, turn, role, text)."""
    talks = {}
    for conv, turn, role, text in rows:
        talk = talks.setdefault(conv, [])
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        fate = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        talk += [(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    out = Counter()
    for conv, talk in talks.items():
        talk.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in talk:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
            seen.add((role, text))
        first = [r[:1] for _, r, _ in talk]
        cost, audit = cheapest(list(zip(first, faults, strict=True)), 3)
        text, said, at = [], "", 0
        for letter in audit:
            _, role, body = talk[at] if letter != "I" else (0, "", "")
            at += letter != "I"
            if letter != "D":
                want = "assistant" if said[-1:] == "u" else "user"
                role = role if letter == "K" else want
                said += role[:1]
                text.append(f"{role}:{body}")
        turns = {t for t, _, _ in talk if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
        out[conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, "\n".join(text)] += 1
    return out


def test_conversations_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(["Yes.", "No", "", None, " \t", "A b c!", "Why? é日本", "x. "])) for c in range(40) for t in rng.sample(range(6), rng.randrange(1, 5))]
    rows += [(None, 1, "user", "Hello."), (None, None, "assistant", "Hm."), (900, None, None, None), (7, 0, "user", "Yes."), (901, 2, "user", "q" * 300_000 + ".")]
    df = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "conv_id bigint, turn bigint, role string, text string, fate string, copy int, gone boolean").repartition(3)
    assert Counter(tuple(r) for r in cr.repaired(cr.damaged(df)).collect()) == repaired_by_hand(rows)
    assert cr.repaired(cr.damaged(df.limit(0))).count() == 0


def test_a_conversation_that_loses_all_rows(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "Hello.")], "conv_id bigint, turn bigint, role string, text string")
    assert [tuple(r) for r in cr.repaired(cr.damaged(df)).collect()] == [(lost, 0, 0, 0, 0, 0, 0, "", "")]


ARTICLE = "<article><h1>Title &amp; more</h1><p>First   <b>bold</b>ly.<br>Second&nbsp;line<p>Third</article>"
PAGES = {
    f"<html><head><title>No</title><style>p{{}}</style><script>var t='</p><article>';</script></head><body><nav><ul><li><a href=/x>Menu</a></ul></nav><div class='ad'>Buy</div>{ARTICLE}<footer>&copy; us</footer>": "Title & more First boldly. Second line Third",
    f"<header><h1>Site</h1></header><div class=\"cookie-notice\">We use cookies</div><aside>side</aside>{ARTICLE}<section id=comments><article class=comment>So true!</article></section><form><p>Name</p></form>": "Title & more First boldly. Second line Third",
    "<article><header><h1>Head</h1><span class=byline>By me</span></header><p>Body<div class='share-buttons'><p>Share</div><p>End <span class='ad'>Buy <span>now</span></span> here</p><footer>Foot</footer></article>": "Head Body End here",
    "<body class='has-sidebar'><main><p>Main text</p><div hidden>gone</div><div style='display: none'>gone</div><noscript>gone</noscript></main><div>outside</div>": "Main text",
    "<p>Plain one</p><p>two<!-- no <p>three</p> --> four": "Plain one two four",
    "<article><table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e</ul></article": "a b c d e",
    "<article><p>1 &lt; 2 &amp; &#x41;&#66; &unknown; &am": "1 < 2 & AB &unknown; &am",
    "<article><p>a < b and c<d>e</d></p></article><p title=\"unclosed>x": "a < b and ce",
    "<ARTICLE CLASS='post commentary'><P>Upper<OL id=commentlist><LI>So true</OL><aside>x</aside><div class='newsletterBox'>y</div><p>case</ARTICLE><div class=article-comments><article>z</article></div>": "Upper case",
    "<article>a<![CDATA[b]]><p/>c<br/>d<svg/><svg><text>no</text></svg><img alt='>'>e<hr>f</p>g": "a c d e f g",
    "no markup at all": "no markup at all",
    "<script>only": "",
    "": "",
    " \n\t ": "",
    None: "",
}


def test_pages_by_structure(spark):
    rows = [(i, f"http://h{i}.example/x", page) for i, page in enumerate(PAGES)] + [(None, None, next(iter(PAGES))), (3, None, None)]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "page_id bigint, url string, html string, body string, host string, part int").repartition(2)
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in hx.main_text(df).collect()}
    assert got == {(i, u): (PAGES[p], len(PAGES[p])) for i, u, p in rows}
    assert hx.main_text(df.limit(0)).count() == 0


def soup(rng, i, host):
    """A page without landmarks: furniture of its host around its own text."""
    own = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    furniture = " ".join(f"{host}menu{j}" for j in range(12))
    below = " ".join(f"{host}below{j}" for j in range(9))
    return f"<div>{furniture}</div><div><p>{own}</p></div><div>{below} page{i}</div>", own + f" page{i}"


def test_repeats_of_a_host_go_and_unique_runs_stay(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for i in range(150):
        host = "big" if i < 100 else f"small{i % 5}"
        page, text = soup(rng, i, host)
        rows.append((i, f"https://{host}.example/{i}?q=1", page))
        want[i] = text
    mirror = "<article><p>" + " ".join(f"m{j}" for j in range(40)) + "</p></article>"
    rows += [(i, "https://big.example/m", mirror) for i in (200, 201, 201)]
    alone = "<p>" + " ".join(f"s{j}" for j in range(40)) + "</p>"
    rows += [(i, "https://copies.example/a", alone) for i in (300, 301)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    for group in (512, 25):
        got = {r.page_id: r.text for r in hx.main_text(df, group=group).collect()}
        assert {i: got[i] for i in want} == want
        assert got[200] == got[201] == " ".join(f"m{j}" for j in range(40))
        assert got[300] == got[301] == " ".join(f"s{j}" for j in range(40))


def test_a_run_on_two_pages_of_a_large_host_goes(spark):
    """Wherever its two pages are dealt: the groups of a host tell each other their runs."""
    rows, want = [], {}
    for i in range(80):
        own = " ".join(f"p{i}w{j}" for j in range(20))
        pair = " ".join(f"pair{i // 2}of{j}" for j in range(hx.LEAST))
        rows.append((i, f"https://big.example/{i}", f"<div>{pair}</div><p>{own}</p>"))
        want[i] = own
    once = " ".join(f"once{j}" for j in range(hx.LEAST))
    rows += [(i, "https://big.example/same", f"<p>{once}</p>") for i in (100, 101, 102, 103)]  # one text
    rows += [(200, None, f"<p>{once}</p>"), (201, "https://big.example/a", f"<article>{rows[0][2]}<p>more</p></article>"), (202, "https://other.example/", rows[2][2])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    for group in (512, 8):
        got = {r.page_id: r.text for r in hx.main_text(df, group=group).collect()}
        assert len(got) == len(rows)
        want[0] = ""  # its own text is on the page with the article too
        assert {i: got[i] for i in want} == want
        assert {got[i] for i in (100, 101, 102, 103, 200)} == {once}
        assert got[201].endswith("p0w19 more") and got[202].startswith("pair1of0") and got[202].endswith("p2w19")


def test_covered_tokens_equal_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(30):
        sizes = rng.integers(0, 30, 6)
        page = np.repeat(np.arange(6), sizes)
        tokens = rng.integers(0, 3, len(page)).astype(np.uint64)
        content = np.array([0, 1, 2, 3, 0, 5])
        for least, pages in ((1, 2), (4, 2), (5, 3)):
            runs = {}
            for i in range(len(tokens) - least + 1):
                if page[i] == page[i + least - 1]:
                    runs.setdefault(tuple(tokens[i : i + least]), []).append(i)
            want = np.zeros(len(tokens), bool)
            for starts in runs.values():
                if len({content[page[i]] for i in starts}) >= pages:
                    for i in starts:
                        want[i : i + least] = True
            assert (hx.covered(tokens, page, content[page], least, pages) == want).all()
    order, rank = hx.suffix_order(np.array([2, 1, 2, 1], np.uint64), np.full(4, 4), 4)
    assert order.tolist() == [3, 1, 2, 0] and len(set(rank.tolist())) == 4


def test_long_and_broken_pages_take_linear_work():
    took = []
    for n in (20_000, 80_000):
        page = "<div class=x><b><p>word" * n + "</b>" * n + "<a href='" * 200
        begun = time.perf_counter()
        blocks_of(page)
        took.append(time.perf_counter() - begun)
    assert took[1] < 10 * took[0]
