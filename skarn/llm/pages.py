"""Main text of web pages by equivalence classes of a host's template.

Every page is read into tokens: the element paths it opens and the text blocks it shows. A token's occurrence vector
over the pages of its host is kept as sums of per-page hashes, so equal vectors have equal sums. Tokens of one host
with the same vector form an equivalence class; classes of several tokens that occur on enough pages are valid, and the
template is what they nest into: the element paths of the class that occurs on every page, the classes inside it, and
the text that belongs to a class and not to a page. What varies inside an element path of the template is a slot. The
slot with the most varying text becomes the host's main path, preferring paths that are marked as an article.

Extraction then keeps the text blocks of the main path, and those of article elements outside it (titles, leads,
captions, closing sections), but for blocks on every page of a host whose articles differ. Blocks in elements that are no reading text (menus, side
bars, notices, adverts, comments, scripts, styles) are never kept, nor are those of forms, unless they hold most of
the text. An element
is told by its name, or by a class, id or role that is such a word. Inside an article a word among others (related-work,
side-effects) only raises a doubt, which the classes settle: the element is left out if the host's template has it, and
kept if it is the page's own. Pages without the host's main path, and pages of hosts without a valid class, keep the
blocks of their own article elements, or of the body, less the host's template text; on hosts of fewer than
LEAST_PAGES pages, which have no template, every doubt leaves an element out.

Defined cases: a null or empty html gives an empty text; pages with a null url, or one without a host, are one host;
rows with a null or repeated page_id are read each by its own html; broken or unclosed markup is read as browsers do
in the common cases (an unknown end tag is skipped, an end tag closes what is open inside it); an empty table gives no
rows; other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Set
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .textbatch import pieces

#: Elements that are skipped with all they hold (a form only where it holds less than half of the text), have no end tag, or end a block.
SKIPPED = frozenset("head title script style noscript template svg math iframe object canvas button select textarea nav aside footer dialog menu audio video".split())
RAW = "script|style|noscript|template|textarea|title|iframe|svg"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html body address article blockquote center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr li main ol p pre section summary table tbody td tfoot th thead tr ul caption form".split()) | SKIPPED
CLOSES_P = BLOCK - frozenset("html body".split())
#: Class, id and role words of elements that are no reading text, and of articles.
NO_TEXT = re.compile(r"(?:ads?|adv|advert\w*|adbox|banner|sidebar|side|menu|nav|navi\w*|breadcrumbs?|footer|masthead|header|cookies?|notices?|consent|promo\w*|sponsor\w*|comments?|replies|respond|share|sharing|social|related|newsletter|subscri\w*|login|signup|popup|modal|disclaimer|toolbar|pagination|pager|widget|complementary|search|contentinfo)")
#: Those of them that only say where an element is; they say nothing inside an article.
PLACES = frozenset("header masthead".split())
ARTICLE = re.compile(r"(?:article\w*|post|entry|story|main|content|maincontent|postbody|body)")

LEAST_PAGES = 3  # of a host, for a class to be valid

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<raw>" + RAW + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I,
)
_MARK = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Za-z0-9]+")


@dataclass
class Block:
    path: str
    text: str
    kept: bool  # in no element that holds no reading text
    article: bool  # in an element marked as an article
    doubts: tuple[str, ...] = ()  # elements inside the article around it, whose names hold a word of no reading text among others
    form: bool = False


def read_page(source: str) -> tuple[dict[str, int], list[Block]]:
    """How often each element path opens, and the text blocks in page order."""
    opened: dict[str, int] = {}
    blocks: list[Block] = []
    stack: list[tuple[str, str, bool, bool, tuple[str, ...]]] = [("", "", True, False, ())]  # name, path, kept, article, doubts
    held: list[str] = []

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            _, path, kept, article, doubts = next(x for x in reversed(stack) if x[0] in BLOCK or not x[0])
            blocks.append(Block(path, text, kept, article, doubts, any(x[0] == "form" for x in stack)))

    def close(names: frozenset[str], stop: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    at = 0
    for m in _TOKEN.finditer(source):
        if m.start() > at:
            held.append(html.unescape(source[at : m.start()]))
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name in BLOCK:
            flush()
        elif name in ("br", "wbr"):
            held.append(" ")
        if m["end"]:
            if any(x[0] == name for x in stack):
                close(frozenset([name]), frozenset())
            continue
        if name in CLOSES_P:
            close(frozenset(["p"]), BLOCK - {"p"})
        if name == "li":
            close(frozenset(["li"]), frozenset(["ul", "ol", "menu"]))
        elif name in ("tr", "td", "th", "dt", "dd"):
            close(frozenset([name] if name == "tr" else ["td", "th"] if name[0] == "t" else ["dt", "dd"]), frozenset(["table", "tr", "dl"]))
        _, path, kept, article, doubts = stack[-1]
        marks = [(k.lower(), (a or b or c).lower()) for k, a, b, c in _MARK.findall(m["rest"])]
        shown = ".".join([name, *(f"{k[0]}{'-'.join(w)}" for k, x in marks if k != "id" and (w := _WORD.findall(x)))])
        path = f"{path}/{shown}"
        is_article = name in ("article", "main") or any(ARTICLE.fullmatch(w) for _, x in marks for w in _WORD.findall(x)) and name not in ("html", "body")
        no_text, whole = name in SKIPPED or name == "header" and not article, name not in ("html", "body", "article", "main")
        for mark in {x for _, x in marks for x in x.split()} if whole else ():
            hits = [w for w in _WORD.findall(mark) if NO_TEXT.fullmatch(w) and not (article and w in PLACES)]
            if hits and (not article or len(_WORD.findall(mark)) == 1):
                no_text = True
            elif hits:
                doubts = (*doubts, f"!{name} {mark}")
        opened[path] = opened.get(path, 0) + 1
        for doubt in doubts[len(stack[-1][4]) :]:
            opened[doubt] = opened.get(doubt, 0) + 1
        if name not in VOID and not m["rest"].endswith("/"):
            stack.append((name, path, kept and not no_text, article or is_article, doubts))
    held.append(html.unescape(source[at:]))
    flush()
    in_forms = sum(len(b.text) for b in blocks if b.kept and b.form)
    if in_forms <= sum(len(b.text) for b in blocks if b.kept and not b.form):
        blocks = [replace(b, kept=False) if b.form else b for b in blocks]
    return opened, blocks


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts)) - (1 << 63)


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "", re.I)
    return m[1].lower() if m else ""


def tokens(pages: DataFrame) -> DataFrame:
    """host, token, path, is_text, length, article, page and how often: a row for each token of each page."""
    store.ship(pages.sparkSession)
    df = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html"):
                out: list[tuple] = []
                for page_id, url, source in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    opened, blocks = read_page(source or "")
                    host = host_of(url)
                    page = _hash(str(page_id), url or "", source or "")
                    counts: dict[tuple, int] = {(_hash("path", p), p, False, 0, False): n for p, n in opened.items()}
                    for b in blocks:
                        if b.kept:
                            key = (_hash("text", b.path, b.text), b.path, True, len(b.text), b.article)
                            counts[key] = counts.get(key, 0) + 1
                    out += [(host, *k, page, n) for k, n in counts.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)] if out else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())], names=["host", "token", "path", "is_text", "length", "article", "page", "times"])

    return df.mapInArrow(run, "host string, token long, path string, is_text boolean, length long, article boolean, page long, times long")


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = 0.2, least_tokens: int = 2) -> DataFrame:
    """host, main (path of the main slot, or null), constant and fixed (hashes of the template's text blocks outside and in articles), doubted (the doubts that are the template's), one row a host."""
    mark = F.xxhash64("page", "times")
    found = tokens(pages).groupBy("host", "token").agg(
        F.first("path").alias("path"), F.first("is_text").alias("is_text"), F.max("length").alias("length"), F.max("article").alias("article"), F.count("*").alias("n_pages"), F.sum("times").alias("n_times"),
        F.sum(F.shiftrightunsigned(mark, 33)).alias("v1"), F.sum(F.bitwise_and(mark, F.lit(0x7FFFFFFF)) if hasattr(F, "bitwise_and") else mark.bitwiseAND(F.lit(0x7FFFFFFF))).alias("v2"),
    )
    found = store.cut(found, "page-tokens")
    hosts = found.groupBy("host").agg(F.max("n_pages").alias("host_pages"))
    classes = found.groupBy("host", "n_pages", "v1", "v2").agg(F.count("*").alias("size"))
    valid = classes.where((F.col("size") >= least_tokens) & (F.col("n_pages") >= least_pages))
    member = found.join(valid, ["host", "n_pages", "v1", "v2"], "left").join(hosts, "host")
    common = F.col("n_pages") >= F.greatest(F.lit(least_pages), F.col("host_pages") * least_share)
    constant = member.where(F.col("is_text") & ~F.col("article") & F.col("size").isNotNull() & common).groupBy("host").agg(F.collect_set("token").alias("constant"))
    doubt = ~F.col("is_text") & F.col("path").startswith("!")
    doubted = member.where(doubt & F.col("size").isNotNull() & common).groupBy("host").agg(F.collect_set("path").alias("doubted"))
    everywhere = F.col("n_pages") == F.col("host_pages")
    fixed = member.where(F.col("is_text") & F.col("article")).groupBy("host").agg(F.collect_set(F.when(everywhere & F.col("size").isNotNull(), F.col("token"))).alias("fixed"), F.count_if(~everywhere).alias("differ")).where("differ > 0").drop("differ")
    frame = member.where(~F.col("is_text") & F.col("size").isNotNull() & (F.col("n_pages") == F.col("host_pages"))).select(F.col("host").alias("_host"), F.col("path").alias("_path"))
    varying = member.where(F.col("is_text") & ~(F.col("size").isNotNull() & common & ~F.col("article"))).groupBy("host", "path", "article").agg(F.sum(F.col("length") * F.col("n_times")).alias("chars"))
    up = varying.withColumn("step", F.split(F.substring("path", 2, 1 << 20), "/"))
    up = up.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size("step")))).withColumn("slot", F.concat(F.lit("/"), F.array_join(F.slice("step", F.lit(1), F.col("depth")), "/")))
    up = up.groupBy("host", "slot").agg(F.sum("chars").alias("chars"), F.sum(F.when(F.col("article"), F.col("chars")).otherwise(0)).alias("in_article"), F.max("depth").alias("depth"))
    up = up.join(frame, (F.col("host") == F.col("_host")) & (F.col("slot") == F.col("_path"))).drop("_host", "_path")
    total = up.groupBy("host").agg(F.max("chars").alias("most"), F.max("in_article").alias("most_article"))
    goal = F.when(F.col("most_article") > 0, F.col("in_article") >= 0.9 * F.col("most_article")).otherwise(F.col("chars") >= 0.9 * F.col("most"))
    main = up.join(total, "host").where(goal).groupBy("host").agg(F.max(F.struct("depth", "slot")).alias("best")).select("host", F.col("best.slot").alias("main"))
    return hosts.select("host").join(main, "host", "left").join(constant, "host", "left").join(fixed, "host", "left").join(doubted, "host", "left").join(hosts.withColumnRenamed("host_pages", "n_pages"), "host")


def choose(blocks: list[Block], main: str | None, constant: Set[int], fixed: Set[int] = frozenset(), doubted: Set[str] | None = None) -> str:
    """The kept blocks of the main path, and of article elements outside it that aren't fixed; else of article elements; else all. The template's text is left out, but for that of articles.

    doubted: the elements of doubtful name that belong to the host's template, and so are left out; None: all are, as there is no template to tell.
    """
    kept = [b for b in blocks if b.kept and not any(doubted is None or d in doubted for d in b.doubts)]
    under = [bool(main) and (b.path == main or b.path.startswith(f"{main}/")) for b in kept]
    inside = [b for b, u in zip(kept, under, strict=True) if u]
    articles = [b for b in kept if b.article]
    if articles and not any(b.article for b in inside):
        inside = articles
    elif inside:
        inside = [b for b, u in zip(kept, under, strict=True) if u or b.article and _hash("text", b.path, b.text) not in fixed]
    return "\n\n".join(b.text for b in inside or kept if b.article or _hash("text", b.path, b.text) not in constant)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""
    store.ship(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    found = store.cut(templates(pages).withColumnRenamed("host", "_host"), "templates")
    df = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).join(found, host == F.col("_host"), "left").select("page_id", "url", "html", "main", "constant", "fixed", "doubted", (F.col("n_pages") >= LEAST_PAGES).alias("several"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html"):
                constant, fixed, doubted = ([set(x or ()) for x in part.column(i).to_pylist()] for i in (4, 5, 6))
                doubted = [x if several else None for x, several in zip(doubted, part.column(7).to_pylist(), strict=True)]
                texts = [choose(read_page(x or "")[1], *how) for x, *how in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), constant, fixed, doubted, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(np.array([len(x) for x in texts], np.int64))], names=["page_id", "url", "text", "n_chars"])

    return df.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
