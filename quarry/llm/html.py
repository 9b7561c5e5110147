"""Main text of web pages by equivalence-class template deduction.

Pages of one host are filled from a template. Tokens are elements, named by their path of tags with
classes and ids. Over the pages of a host a token has an occurrence vector: how often it stands in
each page. Tokens with equal vectors form an equivalence class; classes whose tokens are frequent
are the template's, and they nest, as their paths do. What lies in an element of the template, but
not in a deeper one, is a slot.

1. One pass counts tokens: pages, occurrences, and a fingerprint of the vector (the sum of a page
   hash times the count, which is equal for equal vectors), with figures on the text directly in
   each element. Tasks combine before anything is sent, so a host with many pages is no burden.
2. For each host the classes are formed, those of each layout too, and every slot is judged:
   navigation and the like by name, constant text, link lists; an article or main element makes the
   slots outside it irrelevant. Inside it a slot is template text when it is constant, and a block of
   a slot of links when it is links itself. Text is constant when it is the same on pages whose texts
   differ otherwise, and stands on SUPPORT of the host's pages, or in a layout (a class of tokens) that
   has slots whose text varies, or on OFTEN pages. Nothing can be told from a single page, nor from
   copies of one: hosts without two different pages share one pooled template.
3. A second pass takes each page's text from the slots that are kept. Outside main text elements that
   aren't in the template belong to the slot around them, unless their own name says otherwise. A page
   whose main text would go whole is a repeated page, not a template, and keeps it.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import stage, table

#: The same text so often is template text, also where it stands alone on few of a host's pages.
OFTEN = 8
#: A token is frequent on a host from this share of its pages on.
SUPPORT = 0.5
#: So is one of a layout, from two pages and this share on; a host has so at most 1000 times the paths of a page.
LAYOUT = 0.001
#: Links are a slot's text from this share of its letters on, outside and inside main text.
LINKED, INNER_LINKED = 0.6, 0.9
#: Templates of so many hosts, with so many paths, are broadcast; more are joined by a shuffle.
BROADCAST_HOSTS, BROADCAST_PATHS = 5000, 500_000

_token = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""",
    re.DOTALL,
)
_names = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_hidden = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
_space = re.compile(r"[\x20\x09-\x0D]+")
_digits = re.compile(r"\d+")
_raw_end = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in ("script", "style", "title", "textarea", "noscript", "iframe", "noembed", "noframes", "xmp", "template", "annotation", "annotation-xml")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split()) | frozenset(
    # formulas and drawings: their text is text of the element around; the letters of a drawing are blocks
    """annotation annotation-xml math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder
    munderover semantics svg circle clippath defs desc ellipse filter foreignobject g image line lineargradient marker mask metadata path pattern polygon polyline radialgradient rect stop symbol
    textpath tspan use""".split()
)
#: An opening tag of the key ends an open element of these, if none of the others is between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
DROP_TAGS = frozenset("nav footer aside form button select option datalist dialog menu head object audio video canvas defs desc metadata symbol".split())
#: Words of classes, ids and roles that name what isn't article text.
DROP_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promotion promotions banner banners cookie cookies consent gdpr notice notices alert
    alerts nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars aside rail footer foot masthead topbar toolbar toolbox comment comments commentlist disqus reply replies
    respond share sharing social follow related recommended recommendations popular trending newsletter subscribe subscription signup login search pager pagination paginator widget widgets
    popup modal overlay skip print copyright legal complementary contentinfo""".split()
)
#: Inside main text a class or role that is one of these as a whole drops its element. Words that articles use too (alert, legal, notice, search and so on) need the template's word.
INNER_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promotion promotions cookie cookies gdpr nav navbar navigation menu menus submenu breadcrumb
    breadcrumbs sidebar sidebars masthead topbar toolbar toolbox comment comments commentlist disqus respond share sharing social related recommended recommendations newsletter subscribe
    subscription signup login pager pagination paginator widget widgets popup complementary contentinfo""".split()
)
#: So do these ids, but of no heading: ids name what a section is about.
INNER_IDS = frozenset("comments disqus_thread respond".split())
MAIN_WORDS = frozenset("main articlebody".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_words = re.compile(r"[A-Z]?[a-z]+|[A-Z]+").findall


def element(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """Name of an element in paths, whether it is dropped outside and inside main text, whether it holds the main text."""
    name, drop, main = tag, tag in DROP_TAGS, tag in ("article", "main")
    inner = drop
    if attributes:
        told = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _names.finditer(attributes)]
        if told:
            tokens = {(k, x) for k, v in told for x in v.lower().split()}
            named = {x for k, x in tokens if k in ("class", "role")}
            if tag not in INLINE and tag not in HEADINGS and tag != "main":
                inner = inner or bool(named & INNER_WORDS) or any(k == "id" and x in INNER_IDS for k, x in tokens)
            words = {w.lower() for _, v in told for w in _words(v)} & DROP_WORDS
            if main or ("role", "main") in tokens or ("itemprop", "articlebody") in tokens:
                main, drop = not inner, inner
            elif tag not in ("html", "body"):
                own = {x for k, x in tokens if k in ("class", "id")}
                whole = bool(own & MAIN_WORDS)
                main = whole and not words and not drop
                # A word in a longer name, as in has-sidebar, doesn't drop what is named main as a whole.
                drop = drop or (bool(words & {x for _, x in tokens}) if whole else bool(words))
            name = tag + "".join(f".{_digits.sub('0', v)}" for k, v in told if k in ("class", "id"))
        if _hidden.search(attributes):
            drop = inner = True
    return name.replace("/", "|"), drop, inner, main and not drop


class Page:
    """Text runs of a page in order: path, whether inside something dropped, whether in main text, whether in a link, text, block number."""

    def __init__(self, html: str):
        self.runs: list[tuple[str, bool, bool, bool, str, int]] = []
        self.opened: list[str] = []
        self._read(html)

    def _read(self, html: str) -> None:
        # A frame: tag, path, dropped, main, link. Inline elements add no step to a path.
        stack: list[tuple[str, str, bool, bool, bool]] = [("", "", False, False, False)]
        block, at = 0, 0
        while True:
            m = _token.search(html, at)
            text = html[at : m.start() if m else len(html)]
            if text:
                top = stack[-1]
                self.runs.append((top[1], top[2], top[3], top[4], text, block))
            if not m:
                return
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag = tag.lower()
            inline = tag in INLINE
            if not inline:
                block += 1
            if m[1] or m[4]:
                self._close(stack, tag)
                continue
            if tag == "br":
                self.runs.append((stack[-1][1], stack[-1][2], stack[-1][3], stack[-1][4], " ", block))
            if not inline:
                self._imply(stack, tag)
            attributes = m[3] or m[6] or ""
            if tag in _raw_end:
                end = _raw_end[tag].search(html, at)
                if not attributes.endswith("/"):
                    at = end.end() if end else len(html)
                self.opened.append(f"{stack[-1][1]}/{tag}")
                continue
            name, drop, inner, main = element(tag, attributes)
            _, path, dropped, in_main, link = stack[-1]
            if in_main:
                drop = inner
            if tag == "header" and not in_main:
                drop = True
            if not inline:
                path = f"{path}/{name}"
                self.opened.append(path)
            if tag not in VOID and not (attributes.endswith("/") and inline):
                stack.append((tag, path, dropped or drop, in_main or main, link or tag == "a"))

    @staticmethod
    def _close(stack: list, tag: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag:
                del stack[i:]
                return
            if tag in INLINE and stack[i][0] not in INLINE:
                return  # a stray end of an inline element ends nothing around it

    @staticmethod
    def _imply(stack: list, tag: str) -> None:
        ends, stops = CLOSES.get(tag, (set(), set()))
        for i in range(len(stack) - 1, 0, -1):
            own = stack[i][0]
            if own == "p" or own in ends:
                del stack[i:]
                if own == "p":
                    continue
                if tag not in ("tr",):
                    return
            elif own in stops or (own not in INLINE and own not in ("thead", "tbody", "tfoot") and not ends):
                return


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token figures by host and path of what one task reads: pages, occurrences, fingerprint, characters of text, links and main text, pages with text, least and greatest hash of their text, and of their pages' whole texts."""
    seen: dict[tuple[str, str], list] = {}

    def flush() -> pa.RecordBatch:
        rows = [(*k, *v) for k, v in seen.items()]
        seen.clear()
        kinds = (pa.string(), pa.string(), *[pa.int64()] * 11)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["host", "path", "pages", "n", "print", "chars", "links", "inner", "filled", "lo", "hi", "plo", "phi"])

    for b in batches:
        for i in range(len(b)):
            host, html = host_of(b["url"][i].as_py()), b["html"][i].as_py() or ""
            page, mark = Page(html), zlib.crc32(f"{b['page_id'][i].as_py()} {b['url'][i].as_py()}".encode())
            counts: dict[str, int] = {"": 1}
            for path in page.opened:
                counts[path] = counts.get(path, 0) + 1
            texts: dict[str, list] = {}
            whole = 0
            for path, dropped, in_main, link, text, _ in page.runs:
                if dropped or not (own := text.strip()):
                    continue
                t = texts.setdefault(path, [0, 0, 0, 0])
                t[0] += len(own)
                t[1] += len(own) if link else 0
                t[2] += len(own) if in_main else 0
                t[3] = zlib.crc32(own.encode("utf-8", "replace"), t[3])
                whole = zlib.crc32(own.encode("utf-8", "replace"), whole)
            for path, n in counts.items():
                t = texts.get(path)
                chars, links, inner, text_hash = t or (0, 0, 0, None)
                s = seen.get((host, path))
                if s is None:
                    seen[host, path] = [1, n, mark * n, chars, links, inner, int(t is not None), text_hash, text_hash, *([whole] * 2 if t or not path else [None] * 2)]
                    continue
                for i, x in enumerate((1, n, mark * n, chars, links, inner)):
                    s[i] += x
                if t:
                    s[6] += 1
                    s[7], s[8] = (text_hash, text_hash) if s[7] is None else (min(s[7], text_hash), max(s[8], text_hash))
                if t or not path:
                    s[9], s[10] = (whole, whole) if s[9] is None else (min(s[9], whole), max(s[10], whole))
            if len(seen) > 200_000:
                yield flush()
    yield flush()


def deduce(tokens: pd.DataFrame) -> pd.DataFrame:
    """The template of one host: paths of its classes, those kept, and those that hold links inside main text.

    tokens: the frequent tokens only, so at most 1000 times as many as a page of the host has.
    """
    total = int(tokens["total"].iloc[0])
    figures = {r.path: r for r in tokens.itertuples()}

    varied = {(r.print, r.pages) for r in tokens.itertuples() if r.chars > 0 and r.lo != r.hi}

    def constant(r) -> bool:
        return r.chars > 0 and r.lo == r.hi and r.plo != r.phi and (r.filled >= min(OFTEN, SUPPORT * total) or (r.print, r.pages) in varied)

    def linked(r) -> bool:
        if r.inner:  # the links of headings point to what they head
            return r.links > INNER_LINKED * r.chars and not any(step.split(".")[0] in HEADINGS for step in r.path.split("/"))
        return r.chars > 0 and r.links > LINKED * r.chars

    # A class is the template's if it has several tokens or every page, and a lone token if its text repeats or links.
    sizes = tokens.groupby(["print", "pages"])["path"].transform("size")
    large = {r.path for r, size in zip(tokens.itertuples(), sizes, strict=True) if size > 1 or r.pages == total or constant(r) or linked(r)}
    # Nesting: a path of the template needs its parents in it.
    template = {p for p in large if all(p[:i] in large for i, c in enumerate(p) if c == "/" and i)} | {""}
    # Inside main text a slot is judged by its own text, whatever its parents' classes.
    inner = {p for p in large if figures[p].inner}
    kept, links = [], []
    for p in sorted(template | inner):
        r = figures.get(p)
        if r is not None and linked(r) and r.inner and not constant(r):
            links.append(p)
        elif r is None or not (constant(r) or linked(r)):
            kept.append(p)
    return pd.DataFrame({"group": [tokens["group"].iloc[0]], "template": [sorted(template | inner)], "kept": [kept], "links": [links]})


def templates(pages: DataFrame) -> DataFrame:
    """group, template, kept, links: one row per host with two different pages, and one with group '' for the others together."""
    seen = pages.select("page_id", "url", "html").mapInArrow(observe, "host string, path string, pages long, n long, print long, chars long, links long, inner long, filled long, lo long, hi long, plo long, phi long")
    sums = [F.sum(c).alias(c) for c in ("pages", "n", "chars", "links", "inner", "filled")] + [F.sum(F.col("print").cast("decimal(38,0)")).alias("print"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("plo").alias("plo"), F.max("phi").alias("phi")]
    by_host = stage(seen.groupBy("host", "path").agg(*sums), "tokens")
    hosts = by_host.where("path = ''").select(F.col("host").alias("h"), F.when(F.col("plo") != F.col("phi"), F.col("host")).otherwise("").alias("group"))
    again = [F.sum(c).alias(c) for c in ("pages", "n", "chars", "links", "inner", "filled", "print")] + [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("plo").alias("plo"), F.max("phi").alias("phi")]
    tokens = stage(by_host.join(hosts, F.col("host") == F.col("h")).groupBy("group", "path").agg(*again), "group-tokens")
    total = tokens.where("path = ''").select(F.col("group").alias("g"), F.col("pages").alias("total"))
    frequent = tokens.join(total, F.col("group") == F.col("g")).where((F.col("pages") >= SUPPORT * F.col("total")) | ((F.col("pages") >= 2) & (F.col("pages") >= LAYOUT * F.col("total"))))
    frequent = frequent.select("group", "path", "pages", "total", "chars", "links", "inner", "filled", "lo", "hi", "plo", "phi", F.col("print").cast("string").alias("print"))
    return stage(frequent.groupBy("group").applyInPandas(deduce, "group string, template array<string>, kept array<string>, links array<string>"), "templates")


def extract(html: str, template: frozenset[str], kept: frozenset[str], links: frozenset[str] | bool = False) -> str:
    """The main text of one page; links: slots of links inside main text, or False where there are none."""
    page = Page(html)
    letters: dict[int, list[int]] = {}
    for path, dropped, in_main, link, text, block in page.runs if links else ():
        if in_main and not dropped and path in links:
            n = letters.setdefault(block, [0, 0])
            n[0] += len(text.strip())
            n[1] += len(text.strip()) if link else 0

    def cut(path: str, block: int) -> bool:
        if block in letters:
            return letters[block][1] > LINKED * letters[block][0]
        return path in template and path not in kept and not (links and path in links)

    # A page may lack, or alone have, what its host's template says about main text.
    inside = any(r[2] and not r[1] and r[4].strip() for r in page.runs)
    cutting = any(r[2] and not r[1] and r[4].strip() and not cut(r[0], r[5]) for r in page.runs)
    blocks: list[str] = []
    last, parts = -1, []
    slots: dict[str, bool] = {}
    for path, dropped, in_main, _, text, block in page.runs:
        if dropped or (inside and not in_main):
            continue
        if in_main:
            if cutting and cut(path, block):
                continue
        else:
            ok = slots.get(path)
            if ok is None:
                slot = path
                while slot and slot not in template:
                    slot = slot.rpartition("/")[0]
                ok = slots[path] = slot in kept or not template
            if not ok:
                continue
        if block != last and parts:
            blocks.append("".join(parts))
            parts = []
        last = block
        parts.append(text)
    blocks.append("".join(parts))
    cleaned = (_space.sub(" ", entities.unescape(b)).strip(" ") for b in blocks)
    return "\n\n".join(b for b in cleaned if b)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    Null and empty html gives an empty text, as does a page without article text; html without tags
    is one block. A null url, or one without a host, counts with the hosts of few pages. White space
    (0x20, 0x09-0x0D) is collapsed after character references are decoded, once. Repeated rows are
    pages each. Only page_id, url and html are read. An empty table gives no rows.
    """
    spark = pages.sparkSession
    found = templates(pages)
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    schema = f"{kinds}, text string, n_chars long"

    def result(b: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    none = (frozenset(), frozenset(), frozenset())
    size = found.agg(F.count(F.lit(1)).alias("hosts"), F.coalesce(F.sum(F.size("template")), F.lit(0)).alias("paths")).first()
    if size["hosts"] <= BROADCAST_HOSTS and size["paths"] <= BROADCAST_PATHS:
        told = {r["group"]: (frozenset(r["template"]), frozenset(r["kept"]), frozenset(r["links"])) for r in found.collect()}  # BROADCAST_HOSTS rows and BROADCAST_PATHS paths at most
        shared = spark.sparkContext.broadcast(told)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            get = shared.value.get
            for b in batches:
                texts = []
                for i in range(len(b)):
                    t = get(host_of(b["url"][i].as_py())) or get("") or none
                    texts.append(extract(b["html"][i].as_py() or "", *t))
                yield result(b, texts)

        return pages.select("page_id", "url", "html").mapInArrow(run, schema)

    # Few pages each and many hosts: the pooled template travels as a value, the others by a join that Spark may split.
    pooled = found.where("group = ''").first()
    pool = (frozenset(pooled["template"]), frozenset(pooled["kept"]), frozenset(pooled["links"])) if pooled else none
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#]*)", 1))
    joined = pages.select("page_id", "url", "html", host.alias("_host")).join(found.where("group <> ''"), F.col("_host") == F.col("group"), "left")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for i in range(len(b)):
                own = b["template"][i].as_py()
                t = pool if own is None else (frozenset(own), frozenset(b["kept"][i].as_py()), frozenset(b["links"][i].as_py()))
                texts.append(extract(b["html"][i].as_py() or "", *t))
            yield result(b, texts)

    return joined.select("page_id", "url", "html", "template", "kept", "links").mapInArrow(run_joined, schema)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
