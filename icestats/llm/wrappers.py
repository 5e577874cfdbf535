"""HTML extraction by union-free regular expressions inferred from pages of one host.

A page is a stream of tags and texts. Runs of equal groups fold into repeated groups; two
streams (or wrappers) align on what they share, and what only one of them has becomes
optional; texts that differ become slots, texts equal on all pages stay constants of the
template. Wrappers are inferred per host inside tasks, merged per host, and then every page
is read through its host's wrapper: slots of the article give the text.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icestats.llm.base import query
from icestats.llm.common import slices, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.S | re.I,
)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
#: A new one of these closes an open one of the same kind.
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
FENCE = frozenset("article main section div nav aside header footer table ul ol form body".split())
#: What a page has around its article, by tag and by words of class, id and role.
AROUND = frozenset("nav footer aside form button select option menu head title dialog object canvas".split())
AROUND_WORDS = frozenset(
    "ad ads advert adverts advertisement adsense sponsored sponsor promo promotion banner cookie cookies consent notice notices alert popup modal overlay "
    "sidebar side menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead comment comments reply replies disqus respond "
    "share sharing social related recommended newsletter subscribe subscription signup login search widget toolbar contentinfo complementary".split()
)
MAIN = frozenset(("article", "main"))
#: A class such as has-sidebar tells the state of an element, not what it is.
STATES = re.compile(r"(?:has|have|no|not|with|without|is|hide|hides|show|shows)[-_]|.*[-_](?:by|page)(?:[-_]|$)")
#: Different pages that must agree before an unchanging text counts as the template's.
TEMPLATE_PAGES = 2
#: Below so many, a page on which such texts are the larger part keeps them: it may be a near copy.
SURE_PAGES = 8
LONGEST_GROUP = 24
#: Parts in which the wrappers of one host are merged first.
PARTS = 100
PERIOD = re.compile(rf"(.{{1,{LONGEST_GROUP}}}?)\1+", re.S)


class Page:
    """Tokens of a page: signature, text, context flags and block number of each."""

    def __init__(self, source: str | None):
        self.signs: list[str] = []
        self.texts: list[str] = []
        self.around: list[bool] = []  # inside something that is not the article, by tag or words
        self.tagged: list[bool] = []  # by tag
        self.main: list[bool] = []
        self.link: list[bool] = []
        self.block: list[int] = []
        self._stack: list[tuple[str, bool, bool, int]] = []  # name, around by tag, by words, of words set aside
        self._inside = [0, 0, 0, 0, 0]  # open elements around by tag, by words, of article or main, links, article
        self._n_block = 0
        if source:
            self._read(source)

    def _add(self, sign: str, text: str = "") -> None:
        tagged, worded, main, link, _ = self._inside
        self.signs.append(sign)
        self.texts.append(text)
        self.around.append(tagged + worded > 0)
        self.tagged.append(tagged > 0)
        self.main.append(main > 0)
        self.link.append(link > 0)
        self.block.append(self._n_block)

    def _count(self, element: tuple[str, bool, bool, int], by: int) -> None:
        name, tagged, worded, aside = element
        for k, n in enumerate((tagged, worded - aside, name in MAIN, name == "a", name == "article")):
            self._inside[k] += by * n

    def _open(self, name: str, tagged: bool, worded: bool) -> None:
        """Words of what encloses an article or main do not count in it, unless they are inside another article."""
        aside = self._inside[1] if name in MAIN and not self._inside[4] else 0
        self._stack.append((name, tagged, worded, aside))
        self._count(self._stack[-1], 1)

    def _close(self, at: int) -> None:
        for element in self._stack[at:]:
            self._count(element, -1)
        del self._stack[at:]

    def _read(self, source: str) -> None:
        at = 0
        for m in TOKEN.finditer(source):
            self._text(source[at : m.start()])
            at = m.end()
            name = m[3]
            if name:
                self._tag(name.lower(), bool(m[2]), m[4])
        self._text(source[at:])

    def _text(self, raw: str) -> None:
        if raw:
            text = html.unescape(raw)
            if text.strip():
                self._add("#", text)
            else:
                self._add(" ", " ")  # a blank between inline tags

    def _tag(self, name: str, closing: bool, attributes: str) -> None:
        if name not in INLINE:
            self._n_block += 1
        if closing:
            self._add(f"</{name}>")
            for k in range(len(self._stack) - 1, -1, -1):
                if self._stack[k][0] == name:
                    self._close(k)
                    break
                if self._stack[k][0] in FENCE and name not in FENCE:
                    break
            return
        for k in range(len(self._stack) - 1, -1, -1) if name in CLOSES else ():
            if self._stack[k][0] in CLOSES.get(name, ()):
                self._close(k)
                break
            if self._stack[k][0] in FENCE or self._stack[k][0] in ("table", "ul", "ol", "tr"):
                break
        marks = [" ".join(x for x in g[1:] if x) for g in NAMED.findall(attributes)] if attributes else []
        words = {w for value in marks for part in value.lower().split() if not STATES.match(part) for w in WORDS.findall(part)}
        tagged = name in AROUND or name == "header" and not self._inside[2]
        worded = bool(words & AROUND_WORDS) and name not in MAIN and name != "body"
        label = ".".join(sorted(words)) if tagged or worded else ""
        self._add(f"<{name}{'.' + label if label else ''}>" if name != "br" else "<br>")
        if name not in VOID and not attributes.rstrip().endswith("/"):
            self._open(name, tagged, worded)

    def blocks(self, keep: list[bool]) -> str:
        """The kept texts: blanks joined inside a block, blocks joined by line ends."""
        out: list[str] = []
        last, current = -1, ""
        for sign, text, number, kept in zip(self.signs, self.texts, self.block, keep):
            if number != last:
                out.append(current)
                current, last = "", number
            if sign == "<br>" or sign == " ":
                current += " "
            elif kept:
                current += text
        out.append(current)
        return "\n".join(x for x in (" ".join(b.split()) for b in out) if x)


def fold(signs: list[str], known: tuple[str, ...] = ()) -> list[tuple[str, int, int]]:
    """(signature, first, end) of the stream with runs of equal groups folded to `(...)+`."""
    code: dict[str, str] = {}
    name: dict[str, str] = {}

    def char(sign: str) -> str:
        got = code.get(sign)
        if got is None:
            got = code[sign] = chr(0xE000 + len(code)) if len(code) < 6000 else chr(0x20000 + len(code))
            name[got] = sign
        return got

    spans = [(i, i + 1) for i, sign in enumerate(signs) if sign != " "]
    stream = "".join(char(signs[i]) for i, _ in spans)
    for _ in range(8):
        pieces, joined, at = [], [], 0
        for m in PERIOD.finditer(stream):
            a, b = m.span()
            sign = "(" + " ".join(name[c] for c in m[1]) + ")+"
            pieces += [stream[at:a], char(sign)]
            joined += spans[at:a] + [(spans[a][0], spans[b - 1][1])]
            at = b
        if not pieces:
            break
        stream, spans = "".join(pieces) + stream[at:], joined + spans[at:]
    for sign in known:  # a group that stands once
        inner = sign[1:-2].split(" ")
        if len(inner) > 1 and all(x in code for x in inner) and "(" not in sign[1:]:
            one = "".join(code[x] for x in inner)
            at = stream.find(one)
            while at >= 0:
                stream = stream[:at] + char(sign) + stream[at + len(one) :]
                spans[at : at + len(one)] = [(spans[at][0], spans[at + len(one) - 1][1])]
                at = stream.find(one, at + 1)
    return [(name[c], a, b) for c, (a, b) in zip(stream, spans)]


class Wrapper:
    """Items [signature, optional, texts of its slots (None: they differ), pages that have it].

    With them go the number of pages and the marks of different ones, SURE_PAGES at most.
    """

    def __init__(self, items: list[list] | None = None, pages: int = 0, marks: list[str] | None = None):
        self.items, self.pages, self.marks = items or [], pages, marks or []

    @property
    def groups(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(x[0] for x in self.items if x[0].endswith(")+")))

    def merge(self, other: Wrapper) -> Wrapper:
        if not self.items or not other.items:
            return other if not self.items else self
        mine, theirs, out = [x[0] for x in self.items], [x[0] for x in other.items], []
        for kind, a, b, c, d in SequenceMatcher(None, mine, theirs, autojunk=False).get_opcodes():
            if kind == "equal":
                for x, y in zip(self.items[a:b], other.items[c:d]):
                    out.append([x[0], x[1] or y[1], _agree(x[2], y[2]), x[3] + y[3]])
            else:
                out += [[x[0], True, *x[2:]] for x in [*self.items[a:b], *other.items[c:d]]]
        return Wrapper(out, self.pages + other.pages, sorted({*self.marks, *other.marks})[:SURE_PAGES])

    def template(self, at: int, slot: int) -> bool:
        """Whether a text is equal on all pages of the host, and enough of these are different."""
        _, optional, texts, n = self.items[at]
        whole = not optional and n == self.pages and len(self.marks) >= TEMPLATE_PAGES
        return whole and slot < len(texts) and texts[slot] is not None

    def place(self, folded: list[tuple[str, int, int]]) -> list[int | None]:
        """The item each part of a page falls on."""
        at: list[int | None] = [None] * len(folded)
        matcher = SequenceMatcher(None, [x[0] for x in self.items], [f[0] for f in folded], autojunk=False)
        for a, b, n in matcher.get_matching_blocks():
            for k in range(n):
                at[b + k] = a + k
        return at

    def pattern(self) -> str:
        """The wrapper as a union-free regular expression over signatures."""
        return " ".join(f"({x[0]})?" if x[1] else x[0] for x in self.items)

    def dump(self) -> str:
        return json.dumps([self.items, self.pages, self.marks], ensure_ascii=False)

    @staticmethod
    def load(text: str) -> Wrapper:
        return Wrapper(*json.loads(text))


def _agree(a: list, b: list) -> list:
    return [x if x == y else None for x, y in zip(a, b)] if len(a) == len(b) else [None] * max(len(a), len(b))


def _hash(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _short(text: str) -> str:
    """A text, or what stands for a long one."""
    return text if len(text) <= 300 else "\0" + _hash(text)


def _mark(page: Page) -> str:
    """A hash of what a page says, the same for its copies in other surroundings."""
    said = " ".join(" ".join(t.split()) for t, around in zip(page.texts, page.around) if not around)
    return _hash(" ".join(said.split()))


def of_page(page: Page, known: tuple[str, ...] = ()) -> tuple[Wrapper, list[tuple[str, int, int]]]:
    folded = fold(page.signs, known)
    items = []
    for sign, a, b in folded:
        slots = sign.count("#")
        texts = [" ".join(page.texts[k].split()) for k in range(a, b) if page.signs[k] == "#"]
        alike = len(texts) == slots and not sign.endswith(")+")
        items.append([sign, False, [_short(t) for t in texts] if alike else [None] * slots, 1])
    return Wrapper(items, 1, [_mark(page)]), folded


def menu(sign: str) -> bool:
    """A repeated group whose texts are all links."""
    return sign.endswith(")+") and "#" in sign and all("<a> # </a>" in part for part in sign.split("<li>")[1:]) and "<li>" in sign


def content(page: Page, wrapper: Wrapper) -> list[bool]:
    """Which tokens are texts of the article.

    Words of class, id and role do not count on a page that has no text but in such elements.
    """
    keep = _content(page, wrapper, page.around)
    return keep if any(keep) or page.around == page.tagged else _content(page, wrapper, page.tagged)


def _content(page: Page, wrapper: Wrapper, around: list[bool]) -> list[bool]:
    folded = fold(page.signs, wrapper.groups)
    any_main = any(m and s == "#" and not a for m, s, a in zip(page.main, page.signs, around))
    keep, fixed = [False] * len(page.signs), []
    for (sign, a, b), at in zip(folded, wrapper.place(folded)):
        slot = 0
        for k in range(a, b):
            if page.signs[k] != "#":
                continue
            template = at is not None and not page.main[k] and not sign.endswith(")+") and wrapper.template(at, slot)
            slot += 1
            keep[k] = not around[k] and (page.main[k] if any_main else not menu(sign))
            if keep[k] and template:
                fixed.append(k)
    if len(wrapper.marks) >= SURE_PAGES or 2 * len(fixed) <= sum(keep):
        for k in fixed:
            keep[k] = False
    return keep


def host_of(url: str | None) -> str:
    m = re.match(r".*?://([^/?#]*)", url or "", re.S)
    return m[1].lower() if m else ""


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper) of every host, over all its pages: per task first, then merged."""
    chosen = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Wrapper] = {}

        def flush() -> pa.RecordBatch:
            hosts = list(found)
            out = pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array([found[h].dump() for h in hosts], pa.string())], ["host", "wrapper"])
            found.clear()
            return out

        for batch in batches:
            for part in slices(batch, "html"):
                for url, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if source:
                        host = host_of(url)
                        have = found.get(host)
                        own, _ = of_page(Page(source), have.groups if have else ())
                        found[host] = have.merge(own) if have else own
                if len(found) > 5000:
                    yield flush()
        yield flush()

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        whole = Wrapper()
        for text in sorted(rows["wrapper"]):
            whole = whole.merge(Wrapper.load(text))
        return pd.DataFrame({"host": rows["host"].iloc[:1], "wrapper": [whole.dump()]})

    kinds = "host string, wrapper string"
    # a host that stands in very many tasks is merged in parts
    part = F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part")
    first = chosen.mapInArrow(local, kinds).select("*", part).groupBy("host", "part").applyInPandas(join, kinds)
    return first.groupBy("host").applyInPandas(join, kinds)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page.

    Null or empty html gives an empty text; null and malformed URLs form a host of their
    own; repeated rows are read each; an empty table gives an empty result; other columns
    are not read. Only texts outside article, main and repeated groups that stand on all of
    a host's pages, two different ones at least, and are equal there count as the template's.
    """
    wrappers = infer(pages, url_col, html_col).withColumnRenamed("host", "_host")
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    met = rows.join(wrappers, F.col("host") == F.col("_host"), "left").select("id", "url", "html", "host", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, Wrapper] = {}
        for batch in batches:
            for part in slices(batch, "html"):
                texts = []
                for source, name, text in zip(*(part.column(k).to_pylist() for k in (2, 3, 4))):
                    if not source:
                        texts.append("")
                        continue
                    if name not in loaded:
                        if len(loaded) > 1000:
                            loaded.clear()
                        loaded[name] = Wrapper.load(text) if text else Wrapper()
                    page = Page(source)
                    texts.append(page.blocks(content(page, loaded[name])))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], [id_col, "url", "text"])

    kind = rows.schema["id"].dataType.simpleString()
    out = met.mapInArrow(run, f"`{id_col}` {kind}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


@query("op9_host_wrappers")
def op9(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
