"""Blocks of visible text of one page, each with the place of the page it stands in.

One pass over the tags with one expression: no tree is built, only the open block elements
are kept. Unclosed and unmatched tags are taken as browsers take them: a block closes an open
paragraph, the end of a container closes what is open in it, an end tag without a start is
passed over.
"""

from __future__ import annotations

import html
import re

#: Marks of a block: furniture (never main text), plain, in main, in an article.
FURNITURE, PLAIN, MAIN, ARTICLE = 0, 1, 2, 3

_TOKEN = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# The elements of the markup language and the names that pages give their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas textarea title select datalist audio video noframes xmp".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
DROPPED = frozenset("head nav header footer aside form menu button dialog fieldset search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
FURNITURE_WORDS = frozenset("ad ads adbox adsense advert advertisement adverts advertising sponsor sponsored promo promotion banner menu menubar nav navbar navigation breadcrumb breadcrumbs sidebar sidenav footer masthead topbar cookie cookies gdpr consent notice notices notification disclaimer popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments respond reply replies disqus discussion reactions widget widgets toolbar pagination pager skip skiplink".split())
FURNITURE_STARTS = re.compile(r"comment(?!ar)|advert|cookie|newsletter|sidebar|breadcrumb|navbar|subscri")
COMMENT_WORDS = frozenset("comment comments reply replies respond disqus".split())
MAIN_WORDS = frozenset("articlebody articlecontent articletext postbody postcontent entrycontent storybody maincontent".split())
NEGATIONS = frozenset("no has with without".split())
#: What an opening block closes when it is open and innermost.
PARAGRAPH = frozenset(["p"])
CLOSES = {"li": frozenset("p li".split()), "dt": frozenset("p dt dd".split()), "dd": frozenset("p dt dd".split()), "tr": frozenset("p tr td th".split()), "td": frozenset("p td th".split()), "th": frozenset("p td th".split())}


def _kind(name: str, rest: str, mark: int) -> int:
    """The mark inside an element that opens where `mark` holds."""
    if mark == FURNITURE:
        return FURNITURE
    words: set[str] = set()
    glued: set[str] = set()
    role = prop = ""
    if rest and "=" in rest or "hidden" in rest:
        for key, value in _ATTRIBUTE.findall(rest):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id"):
                for one in value.split():
                    parts = _WORD.findall(_CAMEL.sub("-", one).lower())
                    glued.add("".join(parts))
                    if not NEGATIONS & set(parts):
                        words.update(parts)
            elif key == "role":
                role = value.lower()
            elif key == "itemprop":
                prop = value.lower()
            elif key == "hidden" and value.lower() != "until-found" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return FURNITURE
    if name in ("html", "body"):
        return mark
    if name == "article" or role == "article" or prop == "articlebody":
        return FURNITURE if words & COMMENT_WORDS else ARTICLE
    if name == "main" or role == "main":
        return max(mark, MAIN)
    if name in DROPPED or role in ROLES or words & FURNITURE_WORDS or any(map(FURNITURE_STARTS.match, words)):
        return FURNITURE
    return max(mark, MAIN) if glued & MAIN_WORDS else mark


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(mark, text) of the page's blocks that hold text, in page order: references decoded,
    white space turned to one space, ends trimmed. Headings in the header of an article are
    article; its other content is furniture."""
    out: list[tuple[int, str]] = []
    pieces: list[str] = []
    stack: list[list] = []  # [name, mark inside, mark outside, open elements of the same name inside]
    open_names: dict[str, int] = {}
    mark = PLAIN
    at = 0

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                out.append((mark, text))

    def pop() -> None:
        nonlocal mark
        name, _, mark, _ = stack.pop()
        open_names[name] -= 1

    def above() -> list[str]:
        """Names of the elements from the innermost outwards to the first block, included."""
        names = []
        for name, *_ in reversed(stack):
            names.append(name)
            if name in BLOCKS:
                break
        return names

    while True:
        found = _TOKEN.search(page, at)
        stop = found.start() if found else len(page)
        if stop > at:
            pieces.append(page[at:stop])
        if not found:
            break
        at = found.end()
        name = (found["name"] or "").lower()
        if not name:
            continue
        block = name in BLOCKS
        if found["end"]:
            if block or name == "br":
                flush()
            elif stack and stack[-1][0] == name and stack[-1][3]:
                stack[-1][3] -= 1
                continue
            if open_names.get(name) and (block or name in above()):
                flush()
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name == "br" or name == "hr":
            pieces.append(" ")
            continue
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            if not found["rest"].endswith("/") or name not in ("svg", "math"):
                at = end.end() if end else len(page)
            pieces.append(" ")
            continue
        if block:
            flush()
            while stack and (last := above()[-1]) in CLOSES.get(name, PARAGRAPH):
                while stack[-1][0] != last:
                    pop()
                pop()
            inside = _kind(name, found["rest"], mark)
            if mark == FURNITURE and name in HEADINGS and stack and stack[-1][0] == "header" and stack[-1][2] == ARTICLE:
                inside = ARTICLE
        else:
            inside = _kind(name, found["rest"], mark)
            if inside == mark:
                if stack and stack[-1][0] == name:
                    stack[-1][3] += 1
                continue
            flush()
        stack.append([name, inside, mark, 0])
        open_names[name] = open_names.get(name, 0) + 1
        mark = inside
    flush()
    return out
