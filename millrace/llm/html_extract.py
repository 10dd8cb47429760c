"""Main text of web pages through inferred wrappers.

A host's wrapper is a union-free regular expression over its pages' token streams, held as rules: for each element path the
sequence of what its element contains (elements by tag, class and id; text slots by what stands before them), each item marked
optional or repeated, with repeated groups. Pages are aligned one after another, rule by rule: what only some have becomes
optional, runs of equal items or groups become repeated. This starts inside each task and goes on by host and path or slot, so that
no task sees all pages or all rules of a host.

Each slot notes the different pages that have it, the texts that all of them have there, and how much text it holds. On every
page of a host with at least LEAST_PAGES different pages the wrapper chooses the texts: those that a slot has on all pages are
template, but for what stands between two other texts of the same element, like a heading that all pages have; if articles are a
repeated item and the slots outside them hold more text that differs from page to page, the articles are teasers or comments
and the main text is outside, else it is in the articles, or, on a page without these, in all that isn't template. Pages that
differ in one place only say the same in the others, so inside an article pages count as different only where both their
longest and their second longest text are. Pages of other hosts go by elements alone. Copies of a page count once.

Slots within menus, headers and footers of the page, sidebars, notices, adverts, forms, scripts, styles and reader comments
don't count, by element or by class, id or role. Outside articles one such word in a name is enough; inside articles a name
marks its element only if all its words say so, so that a section "related work" or a box "search-results" stays, and never a
paragraph, heading, quote, list item or table. Names of html, body and main mark nothing. An element whose name marks it but
that holds a main, or an article with more text than all unmarked text, holds main text, and so does, where there is no other
text, one with more text than links. Scripts, icons, buttons and the like inside a block don't end it.

Parsing is linear in the page, nothing recurses; paths are digests, of any depth. Nothing is cut: every slot of a host is decided,
whatever its rule, and a repeat of more than LONGEST_GROUP items stays written out. A rule that is aligned beyond WIDEST items becomes
any number of its items in any order, then of their tags, and one beyond CELLS is aligned by next places; such a rule is loose, and the
articles of its path are then told by what its elements held: two at once, or of two names.

Nulls: null or empty html gives an empty text, a null URL belongs to the host ''. Repeated rows each get their text and
count once for the wrapper. Extra columns don't matter."""

from __future__ import annotations

import hashlib
import html
import itertools
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SALTS, keyed_summary, salt_of, written

#: Different pages of a host from which its wrapper decides.
LEAST_PAGES = 5
#: Bytes of decisions up to which they are broadcast; beyond, pages are joined in parts.
BROADCAST_BYTES = 32 << 20
#: Texts of a host's template up to which its pages carry them all; of more, a page is told its own by a join.
WHOLE_TEMPLATE = 4096
#: Hosts, and rules and slots, that a task holds before it reports them; longest group that is sought as a repeat.
HOSTS, HELD_PARTS, LONGEST_GROUP = 2000, 400_000, 4
#: Items of a rule, and cells of an alignment's table, beyond which items meet at their next place.
WIDEST, CELLS = 512, 40_000

#: HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark picture q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "xmp", "iframe", "noembed", "noframes")}
#: Elements, and words of class, id or role, that hold no main text.
CHROME_TAGS = frozenset("aside button canvas datalist dialog footer form head iframe input menu nav noscript object script select style svg template textarea title".split())
CHROME_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices outbrain pagination popup promo promoted recommended related replies responses search share sharing sidebar skip social sponsor sponsored subscribe taboola toolbar widget".split())
#: Of these, words that also name parts of articles; and words that say nothing beside another.
ARTICLE_WORDS = frozenset("banner recommended related responses search widget masthead".split())
NEUTRAL_WORDS = frozenset("area bar block box bottom bottoms container content group inner item items left link links list right section slot top unit wrap wrapper".split())
ARTICLE_TAGS = frozenset(("article", "main"))
#: Elements without text of their own that stand within a block, and elements that are text whatever their name.
HIDDEN_TAGS = frozenset("button canvas datalist iframe input noscript object script select style svg template textarea".split())
PROSE_TAGS = frozenset("blockquote caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 li p pre q table tbody td tfoot th thead tr".split())
#: Elements whose names say nothing about their text.
UNMARKED = frozenset(("html", "body", "main"))

_OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r""">|=\s*+(["'])""")
_ATTRIBUTES = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_SPLIT = re.compile(r"[^a-z]+")


def _hash(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "replace"), digest_size=8).digest(), "big") >> 1


_paths: dict[tuple[int, str], int] = {}


def _path(parent: int, key: str) -> int:
    found = _paths.get((parent, key))
    if found is None:
        if len(_paths) > 200_000:
            _paths.clear()
        found = _paths[parent, key] = _hash(parent, key)
    return found


_names: dict[tuple[str, str], tuple[str, bool, bool]] = {}


def _key(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """A tag with its class and id, numbers levelled, and whether they mark it outside and inside articles."""
    if len(attributes) < 200 and (tag, attributes) in _names:
        return _names[tag, attributes]
    words, whole, shown = set(), set(), tag
    for name, *values in _ATTRIBUTES.findall(attributes):
        if name.lower() not in ("class", "id", "role"):
            continue
        value = next((v for v in values if v), "").lower()
        words.update(_SPLIT.split(value))
        whole.update(re.sub(r"[-_]?[0-9]+$", "", w) for w in value.split())
        shown += f".{re.sub(r'[0-9]+', '0', ' '.join(sorted(value.split())))}"
    words.discard("")
    inside = words - NEUTRAL_WORDS
    marked = () if tag in UNMARKED else whole if tag == "article" else words
    out = shown, not CHROME_WORDS.isdisjoint(marked), tag not in UNMARKED and tag not in PROSE_TAGS and inside <= CHROME_WORDS and not inside <= ARTICLE_WORDS
    if len(attributes) < 200:
        if len(_names) > 50_000:
            _names.clear()
        _names[tag, attributes] = out
    return out


def tokens(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """(tag, closing, attributes, text): tags, and with tag '' the text between them, decoded. Linear: what a scan to the
    page's end didn't find isn't sought again."""
    at, end, missing = 0, len(page), set()

    def seek(what: str, start: int) -> int:
        found = -1 if what in missing else page.find(what, start)
        if found < 0:
            missing.add(what)
        return found

    def tag_end(start: int) -> int:
        """The > that ends a tag; one inside a quoted value doesn't."""
        k = start
        while "tag" not in missing:
            m = _STOP.search(page, k)
            if not m:
                missing.add("tag")
            elif m[1] is None:
                return m.start()
            else:
                close = seek(m[1], m.end())
                k = close + 1 if close >= 0 else m.end()
        return seek(">", start)

    shown = 0  # text from here on isn't given yet
    while True:
        at = page.find("<", at)
        if at < 0:
            break
        text, tag, closing, attributes, to = "", "", False, "", -1
        if page.startswith("<!--", at):
            to = seek("-->", at + 4)
            to = end if to < 0 else to + 3
        elif page.startswith("<![CDATA[", at):
            to = seek("]]>", at + 9)
            text, to = (page[at + 9 :], end) if to < 0 else (page[at + 9 : to], to + 3)
        elif page.startswith(("<!", "<?"), at):
            to = seek(">", at) + 1
        elif m := _OPEN.match(page, at):
            to = tag_end(m.end()) + 1
            if to > 0:
                tag, closing, attributes = m[2].lower(), bool(m[1]), page[m.end() : to - 1]
        if to <= 0:
            at += 1
            continue
        if at > shown:
            yield "", False, "", html.unescape(page[shown:at])
        if text:
            yield "", False, "", text
        if tag in RAW and not closing:
            m = None if f"</{tag}" in missing else RAW[tag].search(page, to)
            if not m:
                missing.add(f"</{tag}")
                to = end
            else:
                to = seek(">", m.end()) + 1 or end
        if tag:
            yield tag, closing, attributes, ""
        shown = at = to
    if shown < end:
        yield "", False, "", html.unescape(page[shown:])


class Element:
    """An open block element; items are what it holds so far. home: the element itself, or for prose the one that holds it."""

    __slots__ = ("article", "chrome", "hard", "held", "hidden", "home", "inner", "items", "path", "tag")

    def __init__(self, tag: str, path: int, parent: Element | None, hidden: bool = False) -> None:
        self.tag, self.path, self.items = tag, path, []
        self.article = tag in ARTICLE_TAGS or bool(parent and parent.article)
        self.hard = self.chrome = self.inner = False
        self.held = parent.held if parent else 0
        self.hidden = hidden
        self.home = parent.home if parent and tag in PROSE_TAGS else self


class Run:
    """A text run: its slot; whether it is in an article or in chrome, and if so by more than a name; the outermost article that only a
    name around it marks (0: none), and whether it would be in chrome without that name; the text with white space levelled, how much
    of it is in links, and the element that it and its neighbours stand in."""

    __slots__ = ("article", "chrome", "hard", "held", "home", "inner", "linked", "slot", "text")

    def __init__(self, slot: int, e: Element, text: str, linked: int) -> None:
        self.slot, self.article, self.chrome, self.hard, self.held, self.inner, self.text, self.linked, self.home = slot, e.article, e.chrome, e.hard, e.held, e.inner, text, linked, e.home


def parsed(page: str, wrapper: Wrapper | None = None) -> list[Run]:
    """A page's text runs; into the wrapper's rules go the sequences that its elements hold."""
    root = Element("", 0, None)
    stack, open_, out, run, n_held, linked = [root], Counter(), [], [], 0, 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                top = next(e for e in reversed(stack) if not e.hidden)
                key = f"#{top.items[-1]}" if top.items else "#"
                if not key.startswith("##"):  # runs that nothing stands between are one slot
                    top.items.append(key)
                else:
                    key = key[1:]
                out.append(Run(_path(top.path, key), top, text, min(linked, len(text))))
            linked = 0

    def close(depth: int) -> None:
        for e in stack[depth:]:
            open_[e.tag] -= 1
            if wrapper is not None and e.items:
                wrapper.add_rule(e.path, fold([[k, 0, 0, None] for k in e.items]), articles=[_hash(k) for k in e.items if k.split(".")[0] == "article"])
        del stack[depth:]

    inline: Counter = Counter()
    for tag, closing, attributes, text in tokens(page):
        top = stack[-1]
        if not tag:
            if not top.hidden:
                run.append(text)
                linked += len(text) if inline["a"] else 0
            continue
        if tag == "br":
            if not top.hidden:
                run.append(" ")
            continue
        if tag in RAW and not closing:
            if tag not in HIDDEN_TAGS:
                flush()
            continue
        if closing:
            if tag in INLINE and (inline[tag] or not open_[tag]):
                inline[tag] -= inline[tag] > 0
                continue
            depth = next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag) if open_[tag] else 0
            if not (stack[depth].hidden if depth else top.hidden):
                flush()
            if depth:
                close(depth)
            continue
        empty = tag in VOID or attributes.endswith("/")
        if top.hidden:
            if tag not in INLINE and not empty:
                stack.append(Element(tag, top.path, top, hidden=True))
                open_[tag] += 1
            continue
        key, marked, marked_inside = _key(tag, attributes)
        named = marked_inside if top.article else marked
        if tag in HIDDEN_TAGS or (tag in INLINE and named):
            if not empty:
                stack.append(Element(tag, top.path, top, hidden=True))
                open_[tag] += 1
            continue
        if tag in INLINE:
            inline[tag] += tag not in VOID
            continue
        flush()
        if tag in CLOSES_P and stack[-1].tag == "p":
            close(len(stack) - 1)
        while stack[-1].tag in CLOSES_OWN.get(tag, ()):
            close(len(stack) - 1)
        top = stack[-1]
        e = Element(tag, _path(top.path, key), top)
        named = marked_inside if top.article else marked
        hard = tag in CHROME_TAGS or (tag == "header" and not top.article) or (named and (top.article or tag == "article"))
        e.hard = hard or top.hard
        e.chrome = e.hard or named or (top.chrome and tag != "main")
        if not e.held and tag == "article" and e.chrome and not e.hard:
            n_held += 1
            e.held = n_held
        e.inner = e.hard or (top.inner if top.held else not e.held)
        top.items.append(key)
        if not empty:
            stack.append(e)
            open_[tag] += 1
    flush()
    close(0)
    return out


# A rule is a list of items [key, optional, repeated, items of a group or None].


def _same(a: list, b: list) -> bool:
    return a[0] == b[0] and (a[0] != "()" or [i[0] for i in a[3]] == [i[0] for i in b[3]])


def _both(a: list, b: list, repeated: int = 0) -> list:
    inner = None if a[3] is None else [_both(x, y) for x, y in zip(a[3], b[3])]
    return [a[0], a[1] | b[1], a[2] | b[2] | repeated, inner]


def fold(items: list) -> list:
    """Runs of equal items or groups become one repeated item or group."""
    for size in range(1, LONGEST_GROUP + 1):
        out: list = []
        for x in items:
            out.append(x)
            while len(out) >= size + 1:
                last, before = out[-size:], out[-2 * size : -size]
                if any(i[0] == "()" for i in last):
                    break
                if size == 1 and before[0][0] == last[0][0]:
                    out[-2:] = [_both(before[0], last[0], repeated=1)]
                elif size > 1 and len(before) == size and [b[0] for b in before] == [a[0] for a in last]:
                    out[-2 * size :] = [["()", 0, 1, [_both(b, a) for b, a in zip(before, last)]]]
                elif size > 1 and out[-size - 1][0] == "()" and [b[0] for b in out[-size - 1][3]] == [a[0] for a in last]:
                    group = out[-size - 1]
                    out[-size - 1 :] = [["()", group[1], 1, [_both(b, a) for b, a in zip(group[3], last)]]]
                else:
                    break
        items = out
    return items


def _pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a and b that meet, in order: a longest common subsequence where its table is small, else each item's next place."""
    n, m = len(a), len(b)
    if n * m > CELLS:
        places: dict[str, list[int]] = {}
        for i in range(n - 1, -1, -1):
            places.setdefault(a[i][0], []).append(i)
        out, at = [], 0
        for j in range(m):
            left = places.get(b[j][0], [])
            while left and left[-1] < at:
                left.pop()
            if left and _same(a[left[-1]], b[j]):
                at = left.pop() + 1
                out.append((at - 1, j))
        return out
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if _same(a[i], b[j]) else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if _same(a[i], b[j]):
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list, b: list) -> list:
    """One rule for both: what is only in one becomes optional."""
    if a == b:
        return a
    if len(a) == len(b) and all(map(_same, a, b)):
        return [_both(x, y) for x, y in zip(a, b)]
    out, i, j = [], 0, 0
    for p, q in [*_pairs(a, b), (len(a), len(b))]:
        out += [[x[0], 1, *x[2:]] for x in (*a[i:p], *b[j:q])]
        if p < len(a):
            out.append(_both(a[p], b[q]))
        i, j = p + 1, q + 1
    out = fold(out)
    return out if len(out) <= WIDEST else coarse(out)


def coarse(items: list) -> list:
    """Any number of the items in any order, by key, and where these are too many by tag."""
    keys = sorted({k[0] for x in items for k in (x[3] or [x])})
    if len(keys) > WIDEST:
        keys = sorted({k.split(".")[0] for k in keys})
    return [[k, 1, 1, None] for k in keys]


def exact(a: list, b: list) -> bool:
    """Whether align finds one rule for both within its bounds."""
    return (len(a) == len(b) and all(map(_same, a, b))) or (len(a) * len(b) <= CELLS and len(a) + len(b) <= WIDEST)


def _least(*digests: list[int]) -> list[int]:
    return sorted(set().union(*digests))[:LEAST_PAGES]


class Slot:
    """What different pages have in one slot. same: the least and the greatest digest of all that a page has there; common: digests of
    the texts that every page has there; pages, longest, second: the LEAST_PAGES least digests of the pages that have it and of their
    longest and second longest texts; characters; whether it is in an article."""

    __slots__ = ("article", "chars", "common", "longest", "pages", "same", "second")

    def __init__(self, same: list[int], common: list[int], pages: list[int], longest: list[int], second: list[int], chars: int, article: int) -> None:
        self.same, self.common, self.pages, self.longest, self.second, self.chars, self.article = same, common, pages, longest, second, chars, article

    def dump(self) -> list:
        return [self.same, self.common, self.pages, self.longest, self.second, self.chars, self.article]

    def add(self, other: Slot) -> None:
        self.same = [min(self.same[0], other.same[0]), max(self.same[1], other.same[1])]
        self.common = sorted(set(self.common).intersection(other.common))
        self.pages, self.longest, self.second = _least(self.pages, other.pages), _least(self.longest, other.longest), _least(self.second, other.second)
        self.chars, self.article = self.chars + other.chars, self.article | other.article

    def template(self) -> list[int]:
        """Digests of the texts that the host puts on every page."""
        kinds = (self.pages, self.longest, self.second) if self.article else (self.pages,)
        return self.common if all(len(k) >= LEAST_PAGES for k in kinds) else []

    def constant(self) -> bool:
        return self.same[0] == self.same[1] and len(self.pages) >= LEAST_PAGES


def template_key(slot: int, digest: int) -> int:
    return _hash(slot, digest)


class Wrapper:
    """rules: path -> items. loose: paths whose rule was aligned beyond its bounds. articles: path -> the most articles that an element
    held at once, the least and the greatest digest of their names. slots: slot -> Slot. contents: the LEAST_PAGES least digests of
    different pages. A part is (kind, key, value as JSON) of one of these; parts of equal kind and key of any wrappers can be joined alone."""

    def __init__(self) -> None:
        self.rules: dict[int, list] = {}
        self.loose: set[int] = set()
        self.articles: dict[int, list[int]] = {}
        self.slots: dict[int, Slot] = {}
        self.contents: list[int] = []

    @classmethod
    def load(cls, text: str) -> Wrapper:
        out = cls()
        for part in json.loads(text):
            out.add_part(*part)
        return out

    def dump(self) -> str:
        return json.dumps(sorted(self.parts()))

    def parts(self) -> Iterator[tuple[str, int, str]]:
        yield "contents", 0, json.dumps(self.contents)
        for slot, stats in self.slots.items():
            yield "slot", slot, json.dumps(stats.dump())
        for path, items in self.rules.items():
            yield "rule", path, json.dumps([items, path in self.loose, self.articles.get(path)])

    def add_part(self, kind: str, key: int, value: str) -> None:
        held = json.loads(value)
        if kind == "contents":
            self.contents = _least(self.contents, held)
        elif kind == "slot":
            self._slot(key, Slot(*held))
        else:
            self.add_rule(key, held[0], held[1])
            self._articles(key, held[2])

    def add_rule(self, path: int, items: list, loose: bool = False, articles: list[int] = ()) -> None:
        old = self.rules.get(path)
        if loose or (old is not None and not exact(old, items)):
            self.loose.add(path)
        self.rules[path] = items if old is None else align(old, items)
        if articles:
            self._articles(path, [len(articles), min(articles), max(articles)])

    def _articles(self, path: int, new: list[int] | None) -> None:
        if new:
            old = self.articles.get(path, new)
            self.articles[path] = [max(old[0], new[0]), min(old[1], new[1]), max(old[2], new[2])]

    def add_page(self, page: str) -> None:
        own = Wrapper()
        runs = [r for r in parsed(page, own) if not r.chrome]
        for path, items in own.rules.items():
            self.add_rule(path, items, path in own.loose)
            self._articles(path, own.articles.get(path))
        content = _hash("\n".join(r.text for r in runs))
        by_length = sorted({r.text for r in runs}, key=lambda t: (-len(t), t))
        longest, second = (_hash(by_length[k]) if len(by_length) > k else 0 for k in (0, 1))
        texts: dict[int, list] = {}
        for r in runs:
            texts.setdefault(r.slot, [set(), 0, r.article])
            texts[r.slot][0].add(r.text)
            texts[r.slot][1] += len(r.text)
        for slot, (found, chars, article) in texts.items():
            d = _hash("\n".join(sorted(found)))
            self._slot(slot, Slot([d, d], sorted(map(_hash, found)), [content], [longest], [second], chars, int(article)))
        self.contents = _least(self.contents, [content])

    def add(self, other: Wrapper) -> None:
        for part in other.parts():
            self.add_part(*part)

    def _slot(self, slot: int, new: Slot) -> None:
        if slot in self.slots:
            self.slots[slot].add(new)
        else:
            self.slots[slot] = new

    def several(self) -> bool:
        """Whether articles are a repeated item."""
        for path, (most, least, greatest) in self.articles.items():
            held = [k[2] | x[2] for x in self.rules[path] for k in (x[3] or [x]) if k[0].split(".")[0] == "article"]
            if most > 1 or least != greatest if path in self.loose else len(held) > 1 or any(held):
                return True
        return False

    def told(self) -> tuple[list[int], int, bool, bool]:
        """What the parts here add to the host's decision: keys of its template's texts, characters outside articles less those inside,
        of slots that differ from page to page; whether articles repeat; whether there are pages enough."""
        template = sorted({template_key(slot, d) for slot, found in self.slots.items() for d in found.template()})
        more = sum(0 if s.constant() else -s.chars if s.article else s.chars for s in self.slots.values())
        return template, more, self.several(), len(self.contents) >= LEAST_PAGES

    def decided(self) -> tuple[list[int], bool]:
        """The keys of the template's texts, and whether the main text is outside the articles."""
        template, more, several, enough = self.told()
        return (template, several and more > 0) if enough else ([], False)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """What the hosts' wrappers decide, a written table (host, outside boolean, template long): a row for each text of a host's template,
    one with null where the main text is outside and there is no template."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = {}

        def report() -> Iterator[pa.RecordBatch]:
            rows = ((h, *part) for h, w in held.items() for part in w.parts())
            while some := list(itertools.islice(rows, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), (pa.string(), pa.string(), pa.int64(), pa.string()))], ["host", "kind", "key", "value"])
            held.clear()

        parts = 0
        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1)):
                w = held.setdefault(host, Wrapper())
                parts -= len(w.rules) + len(w.slots)
                w.add_page(page.as_py() or "")
                parts += len(w.rules) + len(w.slots)
                if len(held) >= HOSTS or parts >= HELD_PARTS:
                    yield from report()
                    parts = 0
        yield from report()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))

        def each() -> Iterator[tuple]:
            for (host, _, _), same in itertools.groupby(rows, lambda r: r[:3]):
                whole = Wrapper()
                for _, kind, key, value in same:
                    whole.add_part(kind, key, value)
                yield host, *whole.told()

        found = each()
        while some := list(itertools.islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), (pa.string(), pa.list_(pa.int64()), pa.int64(), pa.bool_(), pa.bool_()))], ["host", "template", "more", "several", "enough"])

    parts = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(partial, "host string, kind string, key long, value string")
    dealt = parts.repartition("host", "kind", "key").sortWithinPartitions("host", "kind", "key", "value")
    told = written(dealt.mapInArrow(join, "host string, template array<long>, more long, several boolean, enough boolean"), "parts")
    hosts = told.groupBy("host").agg((F.bool_or("several") & (F.sum("more") > 0)).alias("outside"), F.bool_or("enough").alias("enough")).where("enough").select("host", "outside")
    texts = told.where("size(template) > 0").select("host", F.explode("template").alias("template"))
    return written(hosts.join(texts, "host", "left").where("outside or template is not null").select("host", "outside", "template"), "wrappers")


def _without_template(runs: list[Run], template: set[int]) -> list[Run]:
    """runs but for the template's texts, where these don't stand between two others of the same element."""
    if not template:
        return runs
    own = [template_key(r.slot, _hash(r.text)) not in template for r in runs]
    first, last = {}, {}
    for k, r in enumerate(runs):
        if own[k]:
            first.setdefault(r.home, k)
            last[r.home] = k
    return [r for k, r in enumerate(runs) if own[k] or first.get(r.home, k) < k < last.get(r.home, k)]


def main_text(page: str, template: set[int] = frozenset(), outside: bool = False) -> str:
    """template and outside: what the host's wrapper decided."""
    runs = parsed(page)
    live = _without_template([r for r in runs if not r.chrome], template)
    chosen = [r for r in live if not r.article] if outside else [r for r in live if r.article]
    if not chosen:
        chosen = live
        held = {r.held for r in runs} - {0}
        if len(held) == 1 and not outside:  # several are comments or teasers
            inside = [r for r in runs if r.held and r.article and not r.inner]
            chosen = inside if sum(len(r.text) for r in inside) > sum(len(r.text) for r in live) else live
    if not chosen and not any(not r.chrome for r in runs):  # all stands in elements with telling names: prose is main text even so
        named = [r for r in runs if not r.hard]
        chosen = named if sum(len(r.text) - r.linked for r in named) > sum(r.linked for r in named) else []
    return "\n\n".join(r.text for r in chosen)


def _own_template(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows(host, html), texts(host, template) -> (host, digest of html, template array<long>): the template's texts that a page has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [sorted({template_key(r.slot, _hash(r.text)) for r in parsed(page.as_py() or "") if not r.chrome}) for page in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.list_(pa.int64()))], ["host", "page", "keys"])

    pages = rows.select("host", F.sha2("html", 256).alias("page"), "html").mapInArrow(run, "host string, page string, keys array<long>")
    each = written(pages.select("host", "page", F.explode("keys").alias("template")).withColumn("salt", salt_of(F.col("page"))), "page-texts")
    places = keyed_summary(each, ["host", "template"], "salt", {"n": F.count(F.lit(1))}, {"n": F.sum("n")})
    known = places.join(texts, ["host", "template"]).select("host", "template", "salt")
    return each.join(known, ["host", "template", "salt"]).groupBy("host", "page").agg(F.collect_set("template").alias("own"))


def extracted(pages: DataFrame, wrappers: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url, text, n_chars) of each row."""
    wrappers = infer(pages, url_col, html_col) if wrappers is None else wrappers
    hosts = wrappers.groupBy("host").agg(F.first("outside").alias("outside"), F.count("template").alias("n"))
    large = written(hosts.where(F.col("n") > WHOLE_TEMPLATE).select("host", F.lit(True).alias("large")), "large")
    texts = wrappers.join(large, "host", "left_anti").groupBy("host").agg(F.collect_list("template").alias("template"))
    decisions = written(hosts.join(texts, "host", "left").select("host", F.coalesce("template", F.array().cast("array<long>")).alias("template"), "outside"), "decisions")
    size = decisions.agg(F.sum(F.length("host") + 8 * F.size("template") + 16)).first()[0] or 0
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    if size <= BROADCAST_BYTES:
        placed = rows.join(F.broadcast(decisions), "host", "left")
    else:
        dealt = rows.withColumn("salt", salt_of(F.col("html")))
        places = keyed_summary(dealt.select("host", "salt"), ["host"], "salt", {"n": F.count(F.lit(1))}, {"n": F.sum("n")})
        placed = dealt.join(places.join(decisions, "host").select("host", "salt", "template", "outside"), ["host", "salt"], "left")
    if large.limit(1).count():
        own = _own_template(rows.join(large, "host", "left_semi"), wrappers.join(large, "host", "left_semi").select("host", "template"))
        placed = placed.withColumn("page", F.sha2("html", 256)).join(own, ["host", "page"], "left").withColumn("template", F.coalesce("own", "template"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(page.as_py() or "", set(template.as_py() or ()), bool(outside.as_py())) for page, template, outside in zip(b.column(2), b.column(3), b.column(4))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["id", "url", "text", "n_chars"])

    id_type = pages.schema[id_col].dataType.simpleString()
    return placed.select("id", "url", "html", "template", "outside").mapInArrow(run, f"id {id_type}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
