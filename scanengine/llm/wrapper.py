"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of each host.

A page's stream of tokens is read as a tree of elements, so that streams are aligned level by level and tags stay balanced;
a wrapper is a tree of the same form whose children are a union-free expression: items that come once, optionally (?), repeatedly (+) or both (*), groups of items that repeat together, and text slots.  Wrappers
are folded page by page: repeated siblings fold into repeated items and groups, lists of children are aligned, and what
one side lacks becomes optional.  Each task folds the pages it holds; the few wrappers of a host are then folded in two
steps, so a host with a third of all pages never meets in one task.  Each place in the wrapper keeps how many pages have
it, how much text, how much of it in links, and whether the text differs.  From that the places of the main text follow, and every page of the
host is read by them.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanengine.llm.shared import written

# Element and attribute names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split()
)
DROPPED = frozenset(
    "head nav header footer aside form script style noscript template iframe textarea title svg math button select option input dialog menu "
    "object embed audio video canvas map".split()
)
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup "
    "modal overlay sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments commentlist "
    "disqus replies respond share sharing social related recommended newsletter subscribe subscription signup login search widget pagination pager "
    "complementary contentinfo search dialog".split()
)
MAIN_NAMES = frozenset("main article content post entry story".split())
#: Words that say where or how large a thing is, not what it is.
PLACE_WORDS = frozenset(
    "site page main top bottom left right side inner outer upper lower global primary secondary sub box block wrap wrapper container list links link item items "
    "section area bar slot unit group row col column head body form area list the of js is".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KEPT_WHOLE = frozenset("html body article main".split())
CLOSED_BY_BLOCK = frozenset(["p"])
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>|[^<]++|<", re.S
)
#: An attribute's whole name and its value, if any; attributes are read one after another.
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?")
DEPTH = 120
#: Distinct pages of a host from which on a text that they all have is the template's: the first comparison tells it.
DISTINCT = 2
#: Texts that all pages of a host have are the template's only if they are no more than this share of the pages' text.
SHARE = 0.6
#: A repeated item whose text lies in links to at least this share is a menu.
LINKS = 0.9
#: Hosts whose wrappers a task holds at most; it passes on those it has not met for longest, and they are folded later.
HOSTS = 1000
#: Lists of children that have no unique item in common are aligned by a table of at most so many cells.
CELLS = 250_000


def parse(page: str) -> list:
    """The tree of a page: [tag, name, children], text as str.  name: class, id and role without digits, or None.

    Elements deeper than DEPTH stay open until their own end tags, but what is in them goes to the children of the last
    element above, parted from its neighbours where they are no inline elements; what is_dropped() goes nowhere.
    """
    root: list = ["#root", None, []]
    stack = [root]
    # for each open element the nearest one from it outwards that is not inline; and how many of each tag are open
    block, opened = [0], Counter()
    pos, n = 0, len(page)

    def shut(k: int) -> None:
        parts = any(x[0] not in INLINE for x in stack[max(k, DEPTH) :])
        opened.subtract(x[0] for x in stack[k:])
        del stack[k:], block[k:]
        if parts:
            stack[-1][2].append(["div", None, []])

    while pos < n:
        m = _TOKEN.match(page, pos)
        pos = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                stack[-1][2].append(m[0])
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if opened[tag]:
                shut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            continue
        attrs = m[3] if m[2] else m[6]
        if tag not in INLINE:
            t = stack[block[-1]][0]
            if t in CLOSED_BY_BLOCK or t in SIBLINGS.get(tag, ()):
                shut(block[-1])
        name = None
        if attrs and "=" in attrs or "hidden" in (attrs or ""):
            name = _name(attrs)
        node = [tag, name, []]
        opens = tag not in VOID and tag not in RAW and not attrs.rstrip().endswith("/")
        if opens and len(stack) >= DEPTH:
            gone = is_skipped(node) if tag in INLINE else tag != "header" and is_dropped(key_of(node))
            if tag not in INLINE:
                stack[-1][2].append(["div", None, []])
            if not gone:
                node[2] = stack[-1][2]
        else:
            stack[-1][2].append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
            pos = close.end() if close else n
        elif opens:
            block.append(block[-1] if tag in INLINE else len(stack))
            opened[tag] += 1
            stack.append(node)
    return root


def _name(attrs: str) -> str | None:
    parts = []
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id", "role"):
            parts.append(re.sub(r"\d+", "", value))
        elif (
            key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)
            or key == "hidden"
            or key == "aria-hidden" and value and value.lower() != "false"
        ):
            parts.append("~hidden")
    return " ".join(parts) or None


def key_of(node: list) -> str:
    return node[0] if node[1] is None else f"{node[0]} {node[1]}"


def _squash(text: str) -> str:
    return " ".join(html.unescape(text).split())


# --- wrappers: [key, low, many, children]; key "#" is a text slot, "()" a group; low 0 = optional, many 1 = repeated


def wrap(node: list) -> list:
    """The wrapper of one page's tree.  Inline elements belong to the text slot they stand in."""
    items: list = []
    for c in node[2]:
        if isinstance(c, str):
            slot = bool(c.strip())
        elif c[0] in INLINE:
            slot = bool(c[2])
        else:
            items.append(wrap(c) if c[0] not in DROPPED else [key_of(c), 1, 0, []])
            continue
        if slot and not (items and items[-1][0] == "#"):
            items.append(["#", 1, 0, []])
    return [key_of(node), 1, 0, folded(items)]


def folded(items: list) -> list:
    """Repeats folded: equal neighbours into one repeated item, equal neighbouring runs into a repeated group."""
    out: list = []
    for it in items:
        if out and out[-1][0] == it[0] and it[0] != "()":
            out[-1] = merged(out[-1], it, repeated=True)
        else:
            out.append(it)
    for width in (2, 3, 4):
        k = 0
        while k + 2 * width <= len(out):
            a, b = out[k : k + width], out[k + width : k + 2 * width]
            if [x[0] for x in a] == [x[0] for x in b]:
                group = ["()", 1, 1, [merged(x, y) for x, y in zip(a, b)]]
                j = k + 2 * width
                while [x[0] for x in out[j : j + width]] == [x[0] for x in a]:
                    group[3] = [merged(x, y) for x, y in zip(group[3], out[j : j + width])]
                    j += width
                out[k:j] = [group]
            k += 1
    return out


def merged(a: list, b: list, repeated: bool = False) -> list:
    return [a[0], a[1] & b[1], 1 if repeated else a[2] | b[2], aligned(a[3], b[3])]


def common_run(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places (i, j) of a common subsequence of two lists of keys, rising in both.

    Equal ends are matched first; what is left is parted at the longest rising chain of keys that are unique on both
    sides, and between those a table finds a longest common subsequence.  Where a part has too many cells for that, and
    nothing unique to part it, its items stay unmatched, and so optional.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        n, m = i1 - i0, j1 - j0
        if not n or not m:
            continue
        if n * m <= CELLS:
            best = [[0] * (m + 1) for _ in range(n + 1)]
            for i in range(n - 1, -1, -1):
                for j in range(m - 1, -1, -1):
                    best[i][j] = best[i + 1][j + 1] + 1 if a[i0 + i] == b[j0 + j] else max(best[i + 1][j], best[i][j + 1])
            i = j = 0
            while i < n and j < m:
                if a[i0 + i] == b[j0 + j]:
                    out.append((i0 + i, j0 + j))
                    i, j = i + 1, j + 1
                elif best[i + 1][j] >= best[i][j + 1]:
                    i += 1
                else:
                    j += 1
            continue
        in_a, in_b = Counter(a[i0:i1]), Counter(b[j0:j1])
        at = {a[i]: i for i in range(i0, i1) if in_a[a[i]] == 1}
        chain = rising([(at[b[j]], j) for j in range(j0, j1) if in_b[b[j]] == 1 and b[j] in at])
        edges = [(i0 - 1, j0 - 1), *chain, (i1, j1)]
        out += chain
        todo += [(i + 1, k, j + 1, l) for (i, j), (k, l) in zip(edges, edges[1:])] if chain else []
    return sorted(out)


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs, given with rising j, whose i rise as well."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (i, _) in enumerate(pairs):
        p = bisect_left(tails, i)
        back.append(ends[p - 1] if p else -1)
        if p == len(tails):
            tails.append(i)
            ends.append(k)
        else:
            tails[p], ends[p] = i, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def aligned(a: list, b: list) -> list:
    """Two lists of children as one: a common run of keys is merged, the rest is optional."""
    out: list = []
    i = j = 0
    optional = lambda x: [x[0], 0, x[2], x[3]]
    met = common_run([x[0] for x in a], [x[0] for x in b])
    for k, l in [*met, (len(a), len(b))]:
        out += [optional(x) for x in a[i:k]] + [optional(x) for x in b[j:l]]
        if k < len(a) and l < len(b):
            out.append(merged(a[k], b[l]))
        i, j = k + 1, l + 1
    return out if len(met) == len(a) == len(b) else folded(out)


def expression(w: list) -> str:
    """The wrapper as a regular expression over tags, for people."""
    mark = ("?" if not w[1] else "") if not w[2] else ("+" if w[1] else "*")
    inner = " ".join(expression(c) for c in w[3])
    if w[0] == "#":
        return "#TEXT" + mark
    return f"({inner}){mark}" if w[0] == "()" else f"<{w[0]}>{(' ' + inner + ' ') if inner else ''}</{w[0].split(' ')[0]}>{mark}"


# --- what a host's places hold: path -> [pages, characters, characters in links, the texts that all pages have there, as hash -> characters]


def places(node: list, path: str, out: dict) -> None:
    """Adds each element's own text to out by path."""
    own, links = [], 0
    for c in node[2]:
        if isinstance(c, str):
            own.append(c)
        elif c[0] in INLINE:
            own.append(_inline(c))
            links += len(" ".join(_linked(c).split()))
        elif c[0] not in DROPPED:
            places(c, f"{path}/{key_of(c)}", out)
    text = " ".join("".join(own).split())
    if text:
        _, chars, linked, texts = out.get(path, (1, 0, 0, {}))
        if is_plain(node[0]):
            texts[hash_text(text)] = len(text)
        out[path] = (1, chars + len(text), linked + min(links, len(text)), texts)


def is_plain(tag: str) -> bool:
    """Whether a template's text may stand in such an element: headings and paragraphs are always the page's own."""
    return tag not in HEADINGS and tag not in ("p", "body")


def own_text(node: list) -> str:
    return " ".join("".join(c if isinstance(c, str) else _inline(c) for c in node[2] if isinstance(c, str) or c[0] in INLINE).split())


def _inline(node: list) -> str:
    return " " if node[0] == "br" else "".join(c if isinstance(c, str) else _inline(c) if c[0] in INLINE else " " for c in node[2])


def _linked(node: list) -> str:
    """An inline element's text that lies in links."""
    return _inline(node) if node[0] == "a" else "".join(_linked(c) for c in node[2] if not isinstance(c, str) and c[0] in INLINE)


def add_places(total: dict, new: dict) -> None:
    for path, (pages, chars, links, texts) in new.items():
        if path in total:
            p, c, n, t = total[path]
            total[path] = (p + pages, c + chars, n + links, {h: k for h, k in t.items() if h in texts})
        else:
            total[path] = (pages, chars, links, texts)


def words_of_name(name: str) -> set[str]:
    return set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())) - {""}


def names_of(key: str) -> set[str]:
    return words_of_name(key.partition(" ")[2])


def is_named_aside(key: str) -> bool:
    """Whether one of an element's names says as a whole that it is no main text (`site-footer`, `post-comments`, but not
    `comment-policy-free`), and none that it is (`story`)."""
    names = [words_of_name(x) for x in key.partition(" ")[2].split()]
    if any(x & MAIN_NAMES and x <= MAIN_NAMES | PLACE_WORDS for x in names):
        return False
    return any(x & DROPPED_NAMES and x <= DROPPED_NAMES | PLACE_WORDS | MAIN_NAMES for x in names)


def is_dropped(key: str) -> bool:
    tag = key.partition(" ")[0]
    if tag in DROPPED or "~hidden" in key:
        return True
    return tag not in KEPT_WHOLE and " " in key and is_named_aside(key)


def rules_of(wrapper: list, total: dict, pages: int, distinct: int) -> dict:
    """roots: the places whose text may be main, ranks: how they rank; dropped: places in them that are menus; constant: by
    place the texts, as hashes, that are the template's.

    Main are article and main elements, or else elements of such names, or else the body, or else all; which of them is
    for each page to say, as the pages of a host need not share a template.  The slots of the wrapper tell what is the
    template's, but for headings and paragraphs: the slots of repeated items and groups that hold little but links, wherever
    they are; and outside of article and main elements the texts that all pages have at a place that does not repeat, if any two pages
    differ at all and these texts are no more than a SHARE of what pages hold, as copies of one article differ in little
    but their menus.  Elements below a slot are judged on their own.
    """
    found: list[tuple[int, str]] = []
    dropped: list[str] = []
    constant: dict[str, list[str]] = {}
    whole = sum(chars for path, (_, chars, *_) in total.items() if not any(is_dropped(k) for k in path.split("/")))
    repeated: set[str] = set()

    def walk(w: list, path: str, many: bool, inside: bool) -> None:
        if w[0] == "()":
            for c in w[3]:
                walk(c, path, True, inside)
            return
        here = f"{path}/{w[0]}" if path or w[0] != "#root" else "#root"
        if w[0] == "#" or is_dropped(w[0]):
            return
        tag = w[0].partition(" ")[0]
        rank = 0 if tag == "article" else 1 if tag == "main" or "main" in names_of(w[0]) else 2 if names_of(w[0]) & MAIN_NAMES else 3 if tag == "body" else 9
        if rank < 9:
            found.append((rank, here))
        seen, chars, links, texts = total.get(here, (0, 0, 0, {}))
        many, inside = many or bool(w[2]), inside or rank < 2
        if is_plain(tag) and many and chars and links >= LINKS * chars:
            dropped.append(here)
        elif many:
            repeated.add(here)
        elif texts and not inside and seen == pages and distinct >= DISTINCT:
            constant[here] = sorted(texts)
        for c in w[3]:
            walk(c, here, many, inside)

    walk(wrapper, "", False, False)
    ranks = {path: rank for rank, path in found} | {"#root": 9}
    constant = {k: v for k, v in constant.items() if k not in repeated}
    same = pages * sum(sum(total[k][3].values()) for k in constant)
    return {"roots": sorted(ranks), "ranks": ranks, "dropped": sorted(set(dropped)), "constant": constant if same <= SHARE * whole else {}}


def is_skipped(node: list) -> bool:
    """Whether an inline element's text is left out."""
    return "~hidden" in key_of(node) or bool(node[1] and node[0] != "a" and is_named_aside(key_of(node)))


def roots_of(tree: list, rules: dict) -> set[str]:
    """Of the places whose text may be main the best-ranked that the page has."""
    roots, ranks = set(rules["roots"]), rules.get("ranks", {})
    here: list[tuple[int, str]] = []

    def walk(node: list, path: str) -> None:
        if path in roots:
            here.append((ranks.get(path, 0), path))
        for c in node[2]:
            if isinstance(c, str):
                continue
            if c[0] in INLINE:
                if not is_skipped(c):
                    walk(c, path)
            elif not is_dropped(key_of(c)):
                walk(c, f"{path}/{key_of(c)}")

    walk(tree, "#root")
    best = min((rank for rank, _ in here), default=0)
    return {path for rank, path in here if rank == best}


def main_text(page: str, rules: dict) -> str:
    """The blocks of a page's main text, joined by two line feeds.  A page that would be left with nothing keeps the slots
    that its host drops."""
    tree = parse(page)
    roots = roots_of(tree, rules)
    dropped, constant = set(rules["dropped"]), {k: set(v) for k, v in rules.get("constant", {}).items()}
    return _main_text(tree, roots, dropped, constant) or (_main_text(tree, roots, set(), {}) if dropped or constant else "")


def _main_text(tree: list, roots: set[str], dropped: set[str], constant: dict[str, set[str]]) -> str:
    blocks: list[str] = []
    current: list[str] = []

    def flush() -> None:
        text = _squash("".join(current))
        current.clear()
        if text:
            blocks.append(text)

    def read(node: list, path: str, on: bool, heading_only: bool, muted: bool = False) -> None:
        for c in node[2]:
            if isinstance(c, str):
                if on and not heading_only and not muted:
                    current.append(c)
                continue
            tag, key = c[0], key_of(c)
            if tag == "br":
                if on:
                    current.append(" ")
                continue
            if tag in INLINE and tag not in ("img", "wbr"):
                if not is_skipped(c):
                    read(c, path, on, heading_only, muted)
                continue
            here = f"{path}/{key}"
            inner = on or here in roots
            only = heading_only
            if tag == "header" and inner or inner and "header" in names_of(key) and tag not in KEPT_WHOLE and tag not in DROPPED and "~hidden" not in key:
                only = True
            elif is_dropped(key):
                continue
            if only and tag in HEADINGS:
                only = False
            if inner:
                flush()
            mute = here in dropped or here in constant and hash_text(own_text(c)) in constant[here]
            read(c, here, inner, only, mute)
            if inner:
                flush()

    read(tree, "#root", "#root" in roots, False)
    flush()
    return "\n\n".join(blocks)


WRAPPERS = "host string, salt int, wrapper string, places string, pages long, known array<string>"


class Host:
    """A host's wrapper and places so far; pages of a form that has been seen only add to the places."""

    def __init__(self) -> None:
        self.wrapper, self.places, self.pages, self.seen, self.known = None, {}, 0, set(), set()

    def page(self, text: str) -> None:
        tree = parse(text)
        w = wrap(tree)
        form = json.dumps(w)
        if form not in self.seen:
            if len(self.seen) < 1000:
                self.seen.add(form)
            self.wrapper = w if self.wrapper is None else merged(self.wrapper, w)
        own: dict = {}
        places(tree, "#root", own)
        add_places(self.places, own)
        self.pages += 1
        self.know([hash_text(text)])

    def know(self, hashes: Iterable[str]) -> None:
        """Keeps the smallest hashes of the pages' texts, as many as tell whether DISTINCT pages are distinct."""
        self.known = set(sorted(self.known.union(hashes))[:DISTINCT])

    def add(self, wrapper: list, found: dict, pages: int, known: Iterable[str]) -> None:
        self.wrapper = wrapper if self.wrapper is None else merged(self.wrapper, wrapper)
        add_places(self.places, {k: tuple(v) for k, v in found.items()})
        self.pages += pages
        self.know(known)

    def row(self, host: str, salt: int) -> dict:
        return {"host": host, "salt": salt, "wrapper": json.dumps(self.wrapper), "places": json.dumps(self.places), "pages": self.pages, "known": sorted(self.known)}


def hash_text(text: str | None) -> str:
    import hashlib

    return hashlib.blake2b((text or "").encode("utf-8", "replace"), digest_size=8).hexdigest()


def wrappers(pages: DataFrame, salts: int = 32, written_out: bool = True) -> DataFrame:
    """(host, rules, expression, pages): each host's wrapper and what follows from it.  pages: host, html; written_out:
    whether the expression is."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        hosts: dict[str, Host] = {}
        salt = TaskContext.get().partitionId() % salts
        for pdf in batches:
            for host, text in zip(pdf.host, pdf.html):
                h = hosts.pop(host, None) or Host()
                h.page(text)
                hosts[host] = h  # the last one met is the last one kept
                if len(hosts) > HOSTS:
                    some = list(hosts)[: HOSTS // 2]
                    yield pd.DataFrame([hosts.pop(x).row(x, salt) for x in some])
        if hosts:
            yield pd.DataFrame([h.row(host, salt) for host, h in hosts.items()])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        h = Host()
        for w, found, pages, known in sorted(zip(pdf.wrapper, pdf.places, pdf.pages, map(list, pdf.known))):
            h.add(json.loads(w), json.loads(found), int(pages), known)
        return pd.DataFrame([h.row(pdf.host.iloc[0], int(pdf.salt.iloc[0]))])

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        r = join(pdf).iloc[0]
        w = json.loads(r.wrapper)
        return pd.DataFrame([{"host": r.host, "rules": json.dumps(rules_of(w, json.loads(r.places), int(r.pages), len(r.known))), "expression": expression(w) if written_out else None, "pages": r.pages}])

    parts = pages.select("host", "html").mapInPandas(fold, WRAPPERS)
    some = parts.groupBy("host", "salt").applyInPandas(join, WRAPPERS)
    return some.groupBy("host").applyInPandas(decide, "host string, rules string, expression string, pages long")


def extract(pages: DataFrame) -> DataFrame:
    """A row a page: page_id, url, text (its main text) and n_chars (code points).

    Null html is an empty page, whose text is empty; pages without url share the host ''.  Broken markup is repaired as
    browsers do for the commonest faults (paragraphs and items close each other, stray end tags are ignored, what is
    in elements deeper than 120 joins the last element above).  White space inside a block becomes one blank.  Rows that repeat a page are read
    each.  Other columns are ignored; an empty table gives no rows.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    # a table of known size: it is broadcast only if it is below the session's threshold
    rules = written(wrappers(p, written_out=False).select("host", "rules"), "wrappers")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, dict] = {}
        for pdf in batches:
            out = []
            for text, rule in zip(pdf.html, pdf.rules):
                if rule not in known:
                    known[rule] = json.loads(rule)
                out.append(main_text(text, known[rule]))
            yield pd.DataFrame({"page_id": pdf.page_id, "url": pdf.url, "text": out, "n_chars": [len(t) for t in out]})

    both = p.join(rules, "host").select("page_id", "url", "html", "rules")
    return both.mapInPandas(read, "page_id long, url string, text string, n_chars long")
