"""Main text of web pages by equivalence-class template deduction.

A page is read as tokens: elements, each known by the path of elements above it, and blocks of text at a path.  A token's occurrence
vector says how often each page of the host has it.  Tokens of equal vectors under one class form an equivalence class, so classes nest
by construction; those with several tokens, or on all pages, on at least two pages, make the host's template.  Text in such a class is the template's own
(menus, notices, slogans); all other text is what the pages put into the template's slots.

From the page's root the search goes down through template elements, as long as one of them holds nearly all slot text.  Where no slot
dominates, article or main elements break the tie, and else all slots there are taken, without the elements whose text is the template's alone.
Elements whose name, role or class says that they are menus, adverts, forms, comments and such are no slots, and their text goes also inside the main slot.
A page that lacks its host's slot, or is the only one of its host, is searched by its own elements.

Vectors are never gathered: a vector is known by its number of pages and a sum of hashes of (page, count), which adds up over
partitions, so a host with a third of all pages costs one row a token and partition.  Only tokens on at least one page in RARE reach the deduction: of a host
with d distinct tokens a page on average there are at most RARE * d of these, however many pages it has.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import U64, cut, free_name, mix, table

BROADCAST_BYTES = 16 << 20
#: A template token stands on one page in RARE of its host at least.
RARE = 10
#: Distinct tokens of so many pages' parts are kept in a task before they are sent.
_HELD = 200_000
_MARK = (1 << 40) - 1

#: Comments, tags by the quoting rules of HTML, tags with a quote that never ends (up to the next >), and other markup.
TAG = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+)|["'])*+)(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z))""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s/>="']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*))""")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")

# --- fixed values: what the names of HTML elements, roles and common classes mean ---------------
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source "
                   "mi mo mn ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mstyle mfenced mspace semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
ASIDE = frozenset("head nav footer aside form menu dialog button select template fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs "
    "footer sidebar widget widgets cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription "
    "signup login search share sharing social related recommended recommendations comment comments disqus respond reply replies pagination pager "
    "copyright legal toolbar skip aside adbox adslot adunit adsbygoogle topnav sitenav mainnav subnav sidenav crumbs cookiebar sharebar socials".split()
)
HEADS = frozenset("header masthead banner topbar".split())
#: Words that don't change what a mark beside them says.
NEUTRAL = frozenset(
    "site page main top bottom left right primary secondary global block box area section container wrapper wrap inner outer list item items bar link links "
    "button buttons slot unit zone panel post posts article articles form text title group holder row col column header head policy us icons media feed thread banner "
    "user users reader readers visitor blog recent latest all sticky fixed mobile desktop small large inline google display js custom side end region module count trail for you".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are text of a slot, not slots.
TEXTUAL = HEADINGS | frozenset("p li pre blockquote dt dd ul ol dl figure figcaption caption th hr address details summary".split())
#: Elements whose class and id differ by page on most sites are known by their name alone.
BARE = frozenset("html body article main".split())
CLOSES = {
    **dict.fromkeys("p h1 h2 h3 h4 h5 h6 div section article ul ol dl table blockquote pre header footer nav aside form main figure hr address details".split(), frozenset(["p"])),
    "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"]),
}
#: An open element of these is not closed by a new one inside it.
SCOPES = frozenset("ul ol dl table article section div body html nav aside footer header main form td th".split())

_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?|\Z", re.I | re.A) for name in RAW}
ROOT = 0


def _says(token: str, words: frozenset[str]) -> bool:
    """Whether a whole class or id says one of `words`: each of its parts is one, or neutral beside one."""
    parts = [w for w in re.split(r"[^a-z]+", CAMEL.sub(" ", token).lower()) if w]
    return any(w in words for w in parts) and all(w in words or w in NEUTRAL for w in parts)


@lru_cache(4096)
def _named(attributes: str) -> tuple[str, bool, bool, str]:
    """(label of a path step, whether class or id mark an aside, whether they mark a page's head, role)."""
    got: dict[str, str] = {}
    for k, a, b, c in ATTRIBUTE.findall(attributes):
        got.setdefault(k.lower(), a or b or c)
    own, name = got.get("class", ""), got.get("id", "")
    label = ".".join(sorted(set(re.sub(r"\d+", "0", own.lower()).split()))) + ("#" + re.sub(r"\d+", "0", name.lower()) if name else "")
    tokens = [*own.split(), *name.split()]
    return label, any(_says(t, MARKS) for t in tokens), any(_says(t, HEADS) for t in tokens), got.get("role", "").strip().lower()


@lru_cache(1 << 16)
def _step(above: int, label: str) -> int:
    """The path of an element: a hash, so that a deep one is no longer than others."""
    return int.from_bytes(hashlib.blake2b(f"{above} {label}".encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Page:
    """Elements of a page (parent, name, path, whether aside, in the order in which they open) and its blocks of text (element, text, characters in links).

    With `inline_asides` the text of inline elements that class, id or role mark as asides is left out of its block.
    """

    def __init__(self, source: str, inline_asides: bool = False):
        self._inline_asides = inline_asides
        self._quiet: list | None = None  # of the open inline aside: name, depth of the stack, open elements of its name
        self.parent, self.name, self.path, self.inside = [-1], [""], [ROOT], [False]
        self._hard, self._soft = [False], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self._stack = [0]  # of the open elements
        self._tags = [""]  # their names
        self._open_at: dict[str, list[int]] = {}  # places on the stack by name
        self._scopes: list[int] = []  # places of scopes
        self._text: list[str] = []
        self._linked, self._link = 0, False
        at = 0
        while m := TAG.search(source, at):
            self._take(source[at : m.start()])
            at = m.end()
            if not (name := m[2] or m[5]):
                continue
            name = name.lower()
            if m[1] or m[4]:
                if name not in RAW:
                    self._close(name)
            elif name in RAW:
                end = _RAW_END[name].search(source, at)
                if name == "xmp":
                    self._text.append(source[at : end.start()])
                at = end.end()
            else:
                self._open(name, m[3] or "")
        self._take(source[at:])
        self._flush()
        self.aside = self._asides()

    def _take(self, text: str) -> None:
        if text and not self._quiet:
            text = html.unescape(text) if "&" in text else text
            self._text.append(text)
            if self._link:
                self._linked += len(text)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self._stack[-1], text, self._linked))
        self._text, self._linked, self._link = [], 0, False

    def _open(self, name: str, attributes: str) -> None:
        if name == "br":
            if not self._quiet:
                self._text.append(" ")
            return
        if name in INLINE:
            self._link = self._link or name == "a"
            if self._quiet:
                self._quiet[2] += name == self._quiet[0]
            elif self._inline_asides and name not in VOID and "=" in attributes:
                _, marked, _, role = _named(attributes)
                if marked or role in ROLES:
                    self._quiet = [name, len(self._stack), 1]
            return
        self._flush()
        if closes := CLOSES.get(name):
            scope = next((k for k in reversed(self._scopes) if self._tags[k] not in closes), 0)
            low = len(self._stack)
            for c in closes:
                at = self._open_at.get(c, ())
                k = bisect.bisect_right(at, scope)
                if k < len(at):
                    low = min(low, at[k])
            self._cut(low)
        label, marked, head, role = _named(attributes) if "=" in attributes else ("", False, False, "")
        above = self._stack[-1]
        inside = self.inside[above]
        plain = name in ("html", "body")
        self.parent.append(above)
        self.name.append("main" if role == "main" else name)
        self.path.append(_step(self.path[above], name if name in BARE or not label else f"{name}.{label}"))
        self._hard.append(not plain and (name in ASIDE or role in ROLES or (name == "header" and not inside)))
        self._soft.append(not plain and name not in HEADINGS and (marked or (head and not inside and name not in ("article", "main"))))
        self.inside.append(inside or name in ("article", "main") or role == "main")
        if name not in VOID:
            self._open_at.setdefault(name, []).append(len(self._stack))
            if name in SCOPES:
                self._scopes.append(len(self._stack))
            self._stack.append(len(self.name) - 1)
            self._tags.append(name)

    def _close(self, name: str) -> None:
        if name in INLINE or name in VOID:
            self._link = self._link and name != "a"
            if self._quiet and name == self._quiet[0]:
                self._quiet[2] -= 1
                if not self._quiet[2]:
                    self._quiet = None
            return
        self._flush()
        if at := self._open_at.get(name):
            self._cut(at[-1])

    def _cut(self, k: int) -> None:
        """Closes the elements from k on, and with them an inline aside that was left open in one."""
        for name in self._tags[k:]:
            self._open_at[name].pop()
        while self._scopes and self._scopes[-1] >= k:
            self._scopes.pop()
        del self._stack[k:], self._tags[k:]
        if self._quiet and len(self._stack) < self._quiet[1]:
            self._quiet = None

    def _asides(self) -> list[bool]:
        """Of each element whether it is in an aside.  Where class words would leave a page without article and main no text at all, the heaviest element that they mark isn't one."""
        out = self._spread(self._soft)
        if any(self._soft) and not any(self.inside) and self.blocks and all(out[e] for e, _, _ in self.blocks):
            hard = self._spread([False] * len(out))
            size = [0] * len(out)
            for e, text, _ in self.blocks:
                size[e] += 0 if hard[e] else len(text)
            for k in range(len(out) - 1, 0, -1):
                size[self.parent[k]] += size[k]
            top = max((k for k in range(len(out)) if self._soft[k]), key=lambda k: (size[k], -k))
            if size[top]:
                out = self._spread([s and size[k] != size[top] for k, s in enumerate(self._soft)])
        return out

    def _spread(self, soft: list[bool]) -> list[bool]:
        out = [False]
        for k in range(1, len(self.parent)):
            out.append(out[self.parent[k]] or self._hard[k] or soft[k])
        return out

    def chars(self) -> list[int]:
        """Of each element the characters below it that are in no aside and no link."""
        size = [0] * len(self.parent)
        for e, text, linked in self.blocks:
            if not self.aside[e]:
                size[e] += max(0, len(text) - linked)
        for k in range(len(size) - 1, 0, -1):
            size[self.parent[k]] += size[k]
        return size

    def tokens(self) -> dict[int, list]:
        """path: [occurrences, parent's path, name, characters] of the elements that are in no aside."""
        out: dict[int, list] = {}
        for k, size in enumerate(self.chars()):
            if not self.aside[k]:
                t = out.setdefault(self.path[k], [0, self.path[self.parent[k]] if k else None, self.name[k], 0])
                t[0] += 1
                t[3] += size
        return out

    def text(self, slots: set[int], quiet: set[int] = frozenset()) -> str:
        """The blocks below elements at `slots`, but for those in asides and below `quiet`."""
        state = [0 if ROOT not in slots else 1]
        for k in range(1, len(self.parent)):
            p, above = self.path[k], state[self.parent[k]]
            state.append(2 if above == 2 or p in quiet else 1 if above == 1 or p in slots else 0)
        return "\n".join(t for e, t, _ in self.blocks if state[e] == 1 and not self.aside[e])

    def own_text(self) -> str:
        """The main text by this page's elements alone."""
        tokens = {p: {"parent": t[1], "name": t[2], "chars": t[3]} for p, t in self.tokens().items()}
        found = _descend(tokens, {p: t["chars"] for p, t in tokens.items()}, set(tokens))
        return self.text({*found["slots"], *found["heads"]})


def main_slots(tokens: dict[int, dict], texts: list[dict]) -> dict:
    """Where the main text of a host's pages stands: slots, text elements beside them (heads), and elements in them that hold the template's own text only (quiet).

    `tokens` has by path: parent, name, pages, vector, chars; `texts` has repeated text: path, pages, vector, chars.  Parents are in `tokens` too.
    """
    below: dict = {}
    for p, t in tokens.items():
        below.setdefault(t["parent"], []).append(p)
    cls: dict[int, int] = {}
    number: dict[tuple, int] = {}
    size: Counter[int] = Counter()
    key = lambda t: (t["pages"], t["vector"])
    order = list(below.get(None, []))
    for p in order:  # parents first
        up = tokens[p]["parent"]
        same = up is not None and key(tokens[up]) == key(tokens[p])
        cls[p] = cls[up] if same else number.setdefault((key(tokens[p]), cls.get(up)), len(number))
        size[cls[p]] += 1
        order += below.get(p, [])
    text_cls = []
    for t in texts:
        up = cls[t["path"]]
        own = up if key(tokens[t["path"]]) == key(t) else number.setdefault((key(t), up), len(number))
        size[own] += 1
        text_cls.append(own)
    every = tokens[ROOT]["pages"]
    support = {c: k[0][0] for k, c in number.items()}
    valid = {c for c, n in support.items() if n >= 2 and (size[c] >= 2 or n == every)}
    slot_text = {p: t["chars"] for p, t in tokens.items()}
    for t, c in zip(texts, text_cls, strict=True):
        if c in valid:
            p = t["path"]
            while p is not None:
                slot_text[p] -= t["chars"]
                p = tokens[p]["parent"]
    template = {p for p in tokens if cls[p] in valid} | {ROOT}
    if slot_text[ROOT] <= 0:  # copies of one page: nothing tells template and slots apart
        return _descend(tokens, {p: t["chars"] for p, t in tokens.items()}, template)
    found = _descend(tokens, slot_text, template)
    if found["open"]:
        found["quiet"] = [p for p in found.pop("near") if slot_text[p] <= 0 < tokens[p]["chars"] and tokens[p]["name"] not in TEXTUAL]
    return found


def _descend(tokens: dict[int, dict], weight: dict[int, int], template: set[int]) -> dict:
    """Goes down from the root through template elements that hold nearly all of the weight."""
    kids: dict[int, list[int]] = {}
    order = [ROOT]
    below: dict = {}
    for p, t in tokens.items():
        below.setdefault(t["parent"], []).append(p)
    up = {ROOT: ROOT}
    for p in order:
        for c in below.get(p, []):
            up[c] = c if c in template else up[p]
            if c in template:
                kids.setdefault(up[p], []).append(c)
            order.append(c)

    def topmost(p: int, name: str) -> list[int]:
        out, todo = [], list(kids.get(p, []))
        while todo:
            c = todo.pop()
            if weight[c] > 0 and tokens[c]["name"] == name:
                out.append(c)
            else:
                todo += kids.get(c, [])
        return out

    at, heads = ROOT, []
    while True:
        near = kids.get(at, [])
        full = [c for c in near if weight[c] > 0]
        best = max((c for c in full if tokens[c]["name"] not in TEXTUAL), key=lambda c: (weight[c], c), default=None)
        textual = [c for c in full if tokens[c]["name"] in TEXTUAL]
        if best is None or 10 * weight[best] < 9 * weight[at] or tokens[best]["name"] == "article" or tokens[best]["name"] == "main" and not topmost(best, "article"):
            break
        heads += textual
        at = best
    for name in ("article", "main"):
        if tokens[at]["name"] != name and (own := topmost(at, name)):
            return {"slots": own, "heads": heads + (textual if tokens[at]["name"] == "main" else []), "quiet": [], "open": False}
    return {"slots": [at], "heads": heads, "quiet": [], "open": tokens[at]["name"] not in ("article", "main"), "near": near}


def host(url: str):
    """Host of a URL column, lower-cased; '' if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url}`").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def hash_text(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True)


_ROWS = "host string, path bigint, text bigint, parent bigint, name string, pages bigint, mark bigint, chars bigint"
MAIN = "slots array<bigint>, heads array<bigint>, quiet array<bigint>"


def templates(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, main): where each host of several pages has its main text, from the equivalence classes of its pages' tokens."""

    def tokens(batches):
        held: dict[tuple, list] = {}
        for batch in batches:
            for h, page_key, src in zip(batch.column("host").to_pylist(), batch.column("key").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = Page(src, True)
                found = [((h, p, None), n, up, name, size) for p, (n, up, name, size) in page.tokens().items()]
                texts: dict[tuple, list] = {}
                for e, text, linked in page.blocks:
                    if not page.aside[e]:
                        t = texts.setdefault((h, page.path[e], hash_text(text)), [0, 0])
                        t[0] += 1
                        t[1] += max(0, len(text) - linked)
                found += [(k, n, None, None, size) for k, (n, size) in texts.items()]
                counts = np.array([x[1] for x in found], np.uint64)
                marks = mix(np.full(len(counts), page_key, np.int64).view(np.uint64) ^ (counts << U64(32))) & U64(_MARK)  # sums of 2**23 rows stay in range
                for (k, _, up, name, size), mark in zip(found, marks.tolist(), strict=True):
                    t = held.get(k)
                    if t is None:
                        held[k] = [up, name, 1, mark, size]
                    else:
                        t[2] += 1
                        t[3] = (t[3] + mark) & _MARK
                        t[4] += size
            if len(held) > _HELD:
                yield _rows(held)
                held = {}
        yield _rows(held)

    own = pages.select(host(url).alias("host"), F.xxhash64(F.col(f"`{url}`").cast("string"), F.col(f"`{source}`").cast("string")).alias("key"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("html"))
    rows = own.mapInArrow(tokens, _ROWS)
    sums = rows.groupBy("host", "path", "text").agg(F.first("parent").alias("parent"), F.first("name").alias("name"), F.sum("pages").alias("pages"), F.pmod(F.sum("mark"), F.lit(_MARK + 1)).alias("vector"), F.sum("chars").alias("chars"))
    sums = cut(sums.where("pages > 1"))  # what one page has alone is no template
    hosts = sums.where((F.col("path") == ROOT) & F.col("text").isNull()).select("host", F.col("pages").alias("every"))
    often = sums.join(_small(hosts), "host").where(F.col("pages") * RARE >= F.col("every")).drop("every")
    out = T._parse_datatype_string(f"host string, main struct<{MAIN.replace(' ', ':').replace(',:', ',')}>")
    arrow = to_arrow_schema(out)

    def deduce(batches):
        for batch in batches:
            made = []
            for h, found in zip(batch.column("host").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                elements = {t["path"]: t for t in found if t["text"] is None}
                slots = main_slots(elements, [t for t in found if t["text"] is not None])
                made.append({"host": h, "main": {k: slots[k] for k in ("slots", "heads", "quiet")}})
            yield pa.RecordBatch.from_pylist(made, schema=arrow)

    gathered = often.groupBy("host").agg(F.collect_list(F.struct("path", "text", "parent", "name", "pages", "vector", "chars")).alias("tokens"))  # RARE times a page's at most
    return gathered.mapInArrow(deduce, out)


def _small(frame: DataFrame) -> DataFrame:
    """Broadcast if it is measured to be small."""
    size = frame.agg(F.coalesce(F.sum(F.octet_length("host") + 32), F.lit(0))).first()[0]
    return F.broadcast(frame) if size <= BROADCAST_BYTES else frame


def _rows(held: dict[tuple, list]) -> pa.RecordBatch:
    cols = list(zip(*((*k, *v) for k, v in held.items()), strict=True)) if held else [[]] * 8
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split(" ")[0] for x in _ROWS.split(", ")])


def extract(pages: DataFrame, url: str = "url", source: str = "html", to: str = "text") -> DataFrame:
    """`pages` with `to`, the main text of each page: blocks in page order joined by \\n, white space in them made one space.

    The host's main slots are used where the page has them; else the page's own elements decide.  Null and empty pages, and those without
    text, have the text ''.  Pages without a host form one group.  A repeated page counts as another page of its host.  Very long and very deep pages
    are read whole, in time and memory proportional to their length.  An input column of the name `to` is replaced; all others pass unchanged.  An empty
    table gives an empty table.
    """
    found = cut(templates(pages, url, source))
    size = found.agg(F.coalesce(F.sum(F.octet_length("host") + 8 * (F.size("main.slots") + F.size("main.heads") + F.size("main.quiet")) + 64), F.lit(0))).first()[0]
    key, slot = free_name("host", pages.columns), free_name("main", pages.columns)
    found = found.toDF(key, slot)
    joined = pages.withColumn(key, host(url)).join(F.broadcast(found) if size <= BROADCAST_BYTES else found, key, "left").drop(key)
    columns = [c for c in pages.columns if c != to]
    schema = T.StructType([*(pages.schema[c] for c in columns), T.StructField(to, T.StringType())])
    arrow = to_arrow_schema(schema)

    def scan(batches):
        for batch in batches:
            out = []
            for src, main in zip(batch.column(source).to_pylist(), batch.column(slot).to_pylist(), strict=True):
                page = Page(src or "", True)
                paths = {p for p, aside in zip(page.path, page.aside, strict=True) if not aside}
                if main is None or not paths.intersection(main["slots"]):
                    out.append(page.own_text())
                else:
                    out.append(page.text({*main["slots"], *main["heads"]}, set(main["quiet"])))
            yield pa.RecordBatch.from_arrays([*batch.select(columns).columns, pa.array(out, pa.string())], schema=arrow)

    return joined.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*columns, source])), slot).mapInArrow(scan, schema)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


#: States the result for pages of the test tables' form: one article without inner boilerplate, and few character references.
OP3_SQL = r"""
WITH b AS (
  SELECT page_id, url, string_split_regex(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '<br>', ' ', 'g'), '</?(?:p|h1|h2)>') AS blocks FROM pages
), t AS (
  SELECT page_id, url, list_filter(list_transform(blocks, lambda x:
    trim(regexp_replace(regexp_replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM b
)
SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, length(array_to_string(blocks, chr(10)))::BIGINT AS n_chars FROM t
"""
