"""Main text of HTML pages: host suffix arrays over page token streams.

1. A page is read as blocks of text. Blocks know whether they stand in the element that the page marks
   as its article, in one that is no main text by its name, role or class, or in neither.
2. The token streams of a host's distinct pages, block ends being tokens too, are concatenated and their
   suffixes sorted to the depth of the shortest run that counts as long. Neighbours in that order that
   agree to this depth are a repeated run; one that a large enough share of the distinct pages has is the host's boilerplate.
3. Tokens that boilerplate runs cover are removed and the unique runs kept. In a marked article only
   blocks made of links alone can be removed: a sentence that recurs there is a quotation or a copy.
4. A page that would lose most of its text may be a near copy of others rather than full of boilerplate. It loses
   only runs that are boilerplate beyond doubt, those of many pages and most of the host.

Hosts are cut into parts of bounded size. A part sorts its own suffixes and passes on one row per run with
the number of pages that have it, so counts over a whole host are exact, however large it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docquarry.llm.common import broadcast_if_small
from docquarry.session import materialize

#: Tokens a part is meant to have.
PART_TOKENS = 1 << 18
ARTICLE, LINKS, MAIN, OPEN, ASIDE = range(5)

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(class|id|role|itemprop|aria-hidden|style|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
# Fixed sets of element names.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong "
                    "sub sup time tt u var wbr".split())
_NOT_MAIN = frozenset("nav footer aside form script style noscript iframe svg button select option template dialog menu object canvas video audio head "
                      "title textarea xmp noembed noframes".split())
_NOT_MAIN_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_NOT_MAIN_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adbox|adsense|banner|sponsor(?:ed|s)?|promo|promotion|cookies?|consent|gdpr|notice|"
    r"newsletter|subscribe|popup|modal|overlay|nav|navbar|navigation|menu|breadcrumbs?|sidebar|widget|related|recommended|share|sharing|social|"
    r"comments?|commentlist|disqus|respond|reply|replies|footer|header|masthead|toolbar|pagination|pager|login|signup)(?:$|[\s_-])", re.I)
_COMMENT_WORDS = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|respond)(?:$|[\s_-])", re.I)
_SCOPES = frozenset("article aside blockquote body div dl footer form header html main nav ol section table td th ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass(frozen=True)
class Settings:
    """``run`` tokens make a run long; it is boilerplate if ``pages`` distinct pages of a host have it and they are
    the part ``share`` of all. With ``sure_pages`` and ``sure_share`` it is so beyond doubt."""

    run: int = 8
    pages: int = 3
    share: float = 0.25
    sure_pages: int = 10
    sure_share: float = 0.5


@dataclass
class _Element:
    name: str
    aside: bool
    article: bool
    main: bool
    link: bool


class _Reader:
    """Collects the blocks of one page."""

    def __init__(self):
        self.stack = [_Element("", False, False, False, False)]
        self.blocks: list[tuple[int, str]] = []
        self._parts: list[str] = []
        self._all_links = True

    def text(self, value: str) -> None:
        if not value:
            return
        value = unescape(value) if "&" in value else value
        self._parts.append(value)
        if not self.stack[-1].link and not value.isspace():
            self._all_links = False

    def end_block(self) -> None:
        words = " ".join("".join(self._parts).split())
        if words:
            top = self.stack[-1]
            kind = ASIDE if top.aside else (LINKS if self._all_links else ARTICLE) if top.article else MAIN if top.main else OPEN
            self.blocks.append((kind, words))
        self._parts, self._all_links = [], True

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self._parts.append(" ")
        if name not in _INLINE:
            self.end_block()
            self._close_implied(name)
        if name in _VOID:
            return
        top = self.stack[-1]
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _NAMED.finditer(attributes)} if attributes.strip() else {}
        label = f"{found.get('class', '')} {found.get('id', '')}"
        role = found.get("role", "").lower()
        article = name == "article" or found.get("itemprop", "").lower() == "articlebody"
        main = name == "main" or role == "main"
        if article:
            aside = bool(_COMMENT_WORDS.search(label))
        elif main or name in ("html", "body"):
            aside = False
        else:
            aside = (name in _NOT_MAIN or role in _NOT_MAIN_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
                     or "display:none" in found.get("style", "").replace(" ", "").lower() or bool(_NOT_MAIN_WORDS.search(label))
                     or name == "header" and not top.article)
        self.stack.append(_Element(name, top.aside or aside, top.article or article, top.main or main, top.link or name == "a"))

    def _close_implied(self, name: str) -> None:
        """End tags that HTML lets authors leave out."""
        closed = _CLOSES.get(name, {"p"})
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].name in closed:
                del self.stack[at:]
                return
            if self.stack[at].name in _SCOPES:
                return

    def end(self, name: str) -> None:
        if name not in _INLINE:
            self.end_block()
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].name == name:
                del self.stack[at:]
                return
            if name in _INLINE and self.stack[at].name in _SCOPES:
                return


def blocks(html: str | None) -> list[tuple[int, str]]:
    """(kind, text) of each block of a page in order, white space as single blanks."""
    html = html or ""
    reader, at = _Reader(), 0
    while at < len(html):
        m = _TAG.search(html, at)
        if m is None:
            reader.text(html[at:])
            break
        reader.text(html[at:m.start()])
        at = m.end()
        slash, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if slash:
            reader.end(name)
            continue
        reader.start(name, attributes)
        if name in _RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(html, at)
            at = stop.start() if stop else len(html)
    reader.end_block()
    return reader.blocks


def _judged(found: list[tuple[int, str]]) -> list[int]:
    """Numbers of the blocks whose tokens go into the stream: all that the page does not vouch for."""
    return [i for i, (kind, _) in enumerate(found) if kind != ARTICLE]


def _stream(found: list[tuple[int, str]]) -> list[str]:
    """Tokens of the judged blocks, each block followed by an empty one."""
    return [t for i in _judged(found) for t in (*found[i][1].split(), "")]


def _keyed(pages: DataFrame, url: str, html: str) -> DataFrame:
    """``pages`` with ``_page``, a hash of the whole page, and ``_host``."""
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return pages.withColumns({"_page": F.xxhash64(html), "_host": F.lower(host)})


def streams(pages: DataFrame, url: str, html: str) -> DataFrame:
    """``page``, ``host``, hashed ``tokens``, their ``key``, and whether cuts can change the page's text (``open``)."""
    own = _keyed(pages, url, html).select(F.col("_page").alias("page"), F.col("_host").alias("host"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys, tokens, free = [], [], []
            for page in batch.column(2).to_pylist():
                found = blocks(page)
                hashed = np.array([xxhash.xxh32_intdigest(t.encode()) for t in _stream(found)], dtype=np.uint32)
                keys.append(np.uint64(xxhash.xxh3_64_intdigest(hashed.tobytes())).view(np.int64))
                tokens.append(hashed.view(np.int32))
                wanted = _wanted(found)
                free.append(any(kind in wanted and kind != ARTICLE for kind, _ in found))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(keys, pa.int64()), pa.array(tokens, pa.list_(pa.int32())), pa.array(free, pa.bool_())],
                names=["page", "host", "key", "tokens", "open"])

    return own.mapInArrow(run, "page long, host string, key long, tokens array<int>, open boolean").where(F.size("tokens") > 0)


def sorted_to_depth(tokens: np.ndarray, pages: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank of each suffix by its first ``depth`` tokens) by prefix doubling.

    A suffix ends with its page: what lies beyond ranks before every token, so runs do not cross pages.
    """
    n = len(tokens)
    last = np.searchsorted(pages, pages, side="right")
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    order, done = np.argsort(rank, kind="stable"), 1
    while done < depth:
        step = min(done, depth - done)
        ahead = np.arange(n) + step
        second = np.where(ahead < last, rank[np.minimum(ahead, n - 1)], 0)
        order = np.lexsort((second, rank))
        fresh = np.ones(n, dtype=np.int64)
        fresh[1:] = (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(fresh)
        done += step
    return order, rank


def _run_hashes(tokens: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    h = np.zeros(len(at), dtype=np.uint64)
    for j in range(depth):
        h = (h ^ tokens[at + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _joined(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(all tokens, number of the page of each)."""
    return np.concatenate([np.asarray(t, dtype=np.int32) for t in column]), np.repeat(np.arange(len(column)), [len(t) for t in column])


def _full(pages: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes that have ``depth`` tokens before their page ends."""
    return np.flatnonzero(np.searchsorted(pages, pages, side="right") - np.arange(len(pages)) >= depth)


def boilerplate(dealt: DataFrame, s: Settings) -> DataFrame:
    """``host``, ``part`` and ``run`` (a hash) of the runs in a part that enough pages of the host have, and whether they are ``sure``."""
    depth = s.run

    def count(group: pd.DataFrame) -> pd.DataFrame:
        tokens, pages = _joined(group["tokens"])
        order, rank = sorted_to_depth(tokens, pages, depth)
        order = order[np.isin(order, _full(pages, depth))]
        # One entry per run and page, then one per run with its first place and number of pages.
        seen = np.unique(np.stack([rank[order], pages[order]], axis=1), axis=0)[:, 0]
        ranks, times = np.unique(seen, return_counts=True)
        first = order[np.searchsorted(rank[order], ranks)]
        return pd.DataFrame({"host": group["host"].iloc[0], "part": group["part"].iloc[0], "run": _run_hashes(tokens, first, depth), "n": times,
                             "pages": group["pages"].iloc[0]})

    counted = materialize(dealt.groupBy("host", "part").applyInPandas(count, "host string, part int, run long, n long, pages long"))

    def enough(pages: int, share: float) -> Column:
        return (F.col("n") >= pages) & (F.col("n") >= share * F.col("pages"))

    known = counted.groupBy("host", "run").agg(F.sum("n").alias("n"), F.first("pages").alias("pages")).where(enough(s.pages, s.share))
    return counted.select("host", "part", "run").join(
        known.select("host", "run", enough(s.sure_pages, s.sure_share).alias("sure")), ["host", "run"]).select("host", "part", "run", "sure")


def covered(own: DataFrame, s: Settings) -> DataFrame:
    """``host``, ``key`` of a token stream, the ``gone`` places in it that boilerplate runs cover, and those that ``sure`` ones do."""
    distinct = own.select("host", "key", "tokens").dropDuplicates(["host", "key"])
    sizes = distinct.groupBy("host").agg(F.ceil(F.sum(F.size("tokens")) / PART_TOKENS).cast("int").alias("parts"), F.count("*").alias("pages"))
    dealt = materialize(distinct.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).drop("parts"))

    def mark(group: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        out = {"host": [], "key": [], "gone": [], "sure": []}
        if len(group) and len(runs):
            tokens, pages_of = _joined(group["tokens"])
            at = _full(pages_of, s.run)
            hashes = _run_hashes(tokens, at, s.run)

            def places(of: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
                """(covered places, where those of each page begin)."""
                met = at[np.isin(hashes, of["run"].to_numpy())]
                hit = np.zeros(len(tokens) + 1, dtype=np.int64)
                np.add.at(hit, met, 1)
                np.add.at(hit, met + s.run, -1)
                found = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
                return found, np.searchsorted(pages_of[found], np.arange(len(group) + 1))

            (every, cuts), (sure, sure_cuts) = places(runs), places(runs[runs["sure"]])
            starts = np.searchsorted(pages_of, np.arange(len(group)))
            for i, (host, key) in enumerate(zip(group["host"], group["key"])):
                if cuts[i + 1] > cuts[i]:
                    out["host"].append(host)
                    out["key"].append(key)
                    out["gone"].append((every[cuts[i]:cuts[i + 1]] - starts[i]).astype(np.int32))
                    out["sure"].append((sure[sure_cuts[i]:sure_cuts[i + 1]] - starts[i]).astype(np.int32))
        return pd.DataFrame({name: pd.Series(values, dtype="int64" if name == "key" else object) for name, values in out.items()})

    return (dealt.groupBy("host", "part").cogroup(boilerplate(dealt, s).groupBy("host", "part"))
            .applyInPandas(mark, "host string, key long, gone array<int>, sure array<int>"))


def _wanted(found: list[tuple[int, str]]) -> set[int]:
    """Kinds of block that make up the text of a page."""
    kinds = {kind for kind, _ in found}
    return {ARTICLE, LINKS} if ARTICLE in kinds else {MAIN} if MAIN in kinds else {OPEN}


def _unique(words: list[str], at: int, gone: set[int], run: int) -> list[str]:
    """``words``, which start at place ``at``, without covered stretches.

    A stretch goes if it is long by itself or the whole block: a run from the block before may reach into a
    unique one.
    """
    kept, held = [], []
    for j, word in enumerate(words, at):
        if j in gone:
            held.append(word)
            continue
        if len(held) < run:
            kept += held
        held = []
        kept.append(word)
    return kept + held if kept and len(held) < run else kept


def _mostly_gone(found: list[tuple[int, str]], gone: set[int]) -> bool:
    """Whether more than half of the words that make up the text of a page stand at ``gone`` places."""
    wanted, judged, at, words, lost = _wanted(found), set(_judged(found)), 0, 0, 0
    for i, (kind, text) in enumerate(found):
        n = len(text.split())
        if kind in wanted:
            words += n
            lost += sum(j in gone for j in range(at, at + n)) if i in judged else 0
        at += n + 1 if i in judged else 0
    return 2 * lost > words


def main_text(found: list[tuple[int, str]], gone: set[int], run: int = Settings.run, sure: set[int] = frozenset()) -> str:
    """Text of a page, given its blocks and the boilerplate places in its token stream, all and those beyond doubt."""
    wanted, judged, at, out = _wanted(found), set(_judged(found)), 0, []
    if gone and _mostly_gone(found, gone):
        gone = sure
    for i, (kind, text) in enumerate(found):
        if i in judged:
            words = text.split()
            kept = _unique(words, at, gone, run)
            at += len(words) + 1
            # Links in an article go as a whole or stay; elsewhere the unique runs stay.
            text = text if kind == LINKS and kept else " ".join(kept)
        if kind in wanted and text:
            out.append(text)
    return "\n".join(out)


def extracted(pages: DataFrame, s: Settings = Settings(), url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``, which replace any of that name.

    The text of a NULL or empty page is empty. Pages without a URL belong to one host. Equal pages of a host
    get equal texts and count as one page there. Text that a page marks as its article is returned whole, but
    for link blocks that recur. Ties and the order of rows do not matter.
    """
    own = materialize(streams(pages, url, html))
    cuts = covered(own, s)
    # Only pages whose text a cut can change have to meet their cuts.
    open_pages = own.where("open").select("page", "host", "key").distinct().join(cuts, ["host", "key"])
    cut = materialize(open_pages.select(F.col("page").alias("_cut_page"), F.col("host").alias("_cut_host"), F.col("gone").alias("_gone"), F.col("sure").alias("_sure")))
    columns = [c for c in pages.columns if c not in ("text", "n_chars")]
    keyed = _keyed(pages.select(*columns), url, html)
    met = keyed.join(broadcast_if_small(cut, 4 * F.size("_gone") + 4 * F.size("_sure") + 64),
                     (keyed["_page"] == cut["_cut_page"]) & (keyed["_host"] == cut["_cut_host"]), "left")

    def run(htmls: pd.Series, gone: pd.Series, sure: pd.Series) -> pd.Series:
        return pd.Series([main_text(blocks(page), *(set(), s.run) if g is None else (set(g.tolist()), s.run, set(t.tolist())))
                          for page, g, t in zip(htmls, gone, sure)], dtype=object)

    text = F.pandas_udf(run, "string")(F.col(html), F.col("_gone"), F.col("_sure"))
    return met.select(*columns, text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
