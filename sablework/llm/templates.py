"""Operator 3: main text of web pages by equivalence-class template deduction.

Tokens are tags in their context (the path of open tags with their classes) and
text fragments in theirs. A token's occurrence vector tells on which pages of
its host it occurs and how often; tokens with one vector form an equivalence
class. A class is valid if it holds a tag, has two tokens at least and occurs on
MIN_PAGES pages and half of the host's pages, and if its tags nest in tags of
valid classes. Valid classes make up the host's template; what stands between its
tokens are slots. The text of a page is what is left of its slots without

* the template's own text, and slots in which links hold most of the text, unless nothing would be left,
* where a page marks its article (article, main), all slots outside of it,
* elements that tags or roles mark as menus, headers, footers, forms, scripts and the like,
* elements whose class or id names them so: one whole name, or one with words for a box behind it. Where
  the host has a template, only its elements go by name. What holds the article or
  most of the page's text (of comments: nearly all) never goes by name.

A host of fewer than FEW_PAGES pages needs its tokens on all of them, on two at least.

Vectors are compared by 63-bit sums over pages, so a host may hold a third of all
pages: each task sums up what it reads, and an aggregation adds the sums.
Templates are broadcast if they are small, else joined by host.

Null html counts as empty, pages without text give an empty text; a null url is
a host of its own; broken markup is read as far as it goes, in time linear in the
page's length (a "<" inside a tag, outside of quotes, makes what is before it text);
long pages are read whole; repeated pages are rows of their own, and count as
often in vectors, for all of their tokens alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import left_join_groups, small_batches, written

MIN_PAGES, FEW_PAGES, MIN_SHARE, LINK_SHARE = 2, 5, 0.5, 0.6
#: A name removes at most this share of a page's text; reader comments may outweigh the article.
NAMED_SHARE, COMMENT_SHARE = 0.5, 0.9
#: Templates of up to so many tokens in all are broadcast (24 bytes each); more are joined by host.
BROADCAST_TOKENS = 500_000
# Elements by what they are for.
BOILERPLATE = frozenset("nav header footer aside form script style noscript template iframe svg head button select textarea dialog menu object canvas audio video".split())
MAIN = frozenset(("article", "main"))
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice notices alert popup modal newsletter subscribe sidebar"
    " menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus reply replies respond related share sharing social"
    " widget pagination pager copyright legal toolbar".split()
)
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
BOXES = frozenset("area bar block box container holder inner list panel section slot unit wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar toolbar".split())
#: Comments, declarations and tags. Nothing is tried twice: a "<" outside of quotes ends what isn't a tag after all.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
ATTR = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def boilerplate(tag: str, attrs: dict[str, str]) -> bool:
    return tag in BOILERPLATE or "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES


def named(tag: str, attrs: dict[str, str]) -> float:
    """The share of a page's text that the element's names may remove; 0 if it has no such name."""
    if tag in ("html", "body") or tag in MAIN and "comment" not in attrs.get("class", ""):
        return 0.0
    share = 0.0
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        first, *rest = re.split(r"[-_]+", name)
        if first in NAMES and all(w in BOXES for w in rest):
            share = max(share, COMMENT_SHARE if first in COMMENTS else NAMED_SHARE)
    return share


@dataclass
class Open:
    """An open element."""

    tag: str
    context: int
    link: bool = False
    bad: bool = False
    main: bool = False
    slot: int = 0  # context of the innermost element that is no inline one
    name: int = -1  # the innermost element with a name
    p_at: int = -1  # the open paragraph, and the open item, that a block's start tag or an item's would end
    li_at: int = -1


class Page:
    """Tags and text fragments of one page with their contexts, read in one pass."""

    def __init__(self, source: str) -> None:
        self.tags: dict[int, list[int]] = {}  # context -> [times, parent's context]
        # context, block, text, link, boilerplate, main, slot, innermost element with a name
        self.fragments: list[tuple[int, int, str, bool, bool, bool, int, int]] = []
        self.names: list[list] = []  # context, share, whether it holds the article, the name around it
        self.has_main = False
        self.slots: dict[int, int] = {}
        stack = [Open("", 0)]
        depth: Counter[str] = Counter()
        block = pos = 0
        n = len(source)

        def close(at: int) -> None:
            depth.subtract(x.tag for x in stack[at:])
            del stack[at:]

        while pos < n:
            m = TAG.search(source, pos)
            end = m.start() if m else n
            top = stack[-1]
            if end > pos:
                self.fragments.append((top.context, block, source[pos:end], top.link, top.bad, top.main, top.slot, top.name))
            if not m:
                break
            pos = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if tag not in INLINE:
                block += 1
            if m[1]:
                if depth[tag] > 0:
                    close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
                continue
            attrs = {a[0].lower(): html_lib.unescape(a[1] or a[2] or a[3]) for a in ATTR.findall(m[3])} if m[3].strip(" /") else {}
            if tag in ENDS_P or tag == "li":
                # An open paragraph or item ends here, with what is open inside it.
                at = top.li_at if tag == "li" else top.p_at
                if at > 0:
                    close(at)
            top = stack[-1]
            inner = xxhash.xxh64_intdigest(f"{tag}.{attrs.get('class', '')}", top.context) >> 1
            self.tags.setdefault(inner, [0, top.context])[0] += 1
            if tag in VOID or m[3].endswith("/"):
                continue
            bad = top.bad or boilerplate(tag, attrs)
            share = 0.0 if bad else named(tag, attrs)
            main, name = top.main, top.name
            if tag in MAIN and not bad and not share:
                main = self.has_main = True
                i = name
                while i >= 0 and not self.names[i][2]:
                    self.names[i][2] = True
                    i = self.names[i][3]
            if share:
                self.names.append([inner, share, False, name])
                name = len(self.names) - 1
            inline = tag in INLINE
            stack.append(
                Open(
                    tag, inner, top.link or tag == "a", bad, main, top.slot if inline else inner, name,
                    len(stack) if tag == "p" else top.p_at if inline else -1,
                    len(stack) if tag == "li" else top.li_at if inline or tag == "p" else -1,
                )
            )
            depth[tag] += 1
            if tag in RAW:
                # No markup inside: up to the end tag, or the end of the page.
                ends = re.compile(rf"</{tag}\s*>", re.I).search(source, pos)
                pos = ends.start() if ends else n

    def removed_names(self, tags: frozenset[int]) -> list[bool]:
        """Which elements with names go, by themselves or with one around them."""
        size, total = [0] * len(self.names), 0
        for _, _, raw, _, bad, _, _, name in self.fragments:
            n = 0 if bad else len(raw.strip())
            total += n
            if name >= 0:
                size[name] += n
        for i in range(len(self.names) - 1, -1, -1):
            if self.names[i][3] >= 0:
                size[self.names[i][3]] += size[i]
        gone: list[bool] = []
        for i, (context, share, holds, around) in enumerate(self.names):
            own = not holds and size[i] <= share * total and (not tags or context in tags)
            gone.append(own or around >= 0 and gone[around])
        return gone

    def nearest(self, context: int, tags: frozenset[int]) -> int:
        """The innermost tag of the template around a context: its slot."""
        way = []
        while context and context not in tags and context not in self.slots:
            way.append(context)
            context = self.tags[context][1]
        found = self.slots.get(context, context)
        for c in way:
            self.slots[c] = found
        return found

    def text(self, tags: frozenset[int], template: frozenset[int], link_slots: frozenset[int]) -> str:
        gone = self.removed_names(tags)
        kept = [f for f in self.fragments if not (f[4] or self.has_main and not f[5] or f[7] >= 0 and gone[f[7]])]
        # Blocks with text of the page's own are kept whole: the template also has words and full stops inside sentences.
        live = {f[1] for f in kept if f[2].strip() and fragment_token(f[0], f[2]) not in template and self.nearest(f[6], tags) not in link_slots}
        # Where nothing is left, pages are copies of one page, and the template has all of it.
        own = [f for f in kept if f[1] in live] if live else kept
        blocks: dict[int, list[str]] = {}
        for f in own:
            blocks.setdefault(f[1], []).append(html_lib.unescape(f[2]))
        lines = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
        return "\n".join(x for x in lines if x)


def fragment_token(context: int, raw: str) -> int:
    return xxhash.xxh64_intdigest(" ".join(html_lib.unescape(raw).split()), context ^ 0x7E57) >> 1


def host_of(url: str | None) -> str:
    try:
        return urlsplit(url or "").netloc.lower()
    except ValueError:
        return ""


def occurrences(pages: DataFrame) -> DataFrame:
    """host, kind (0 page, 1 tag, 2 text), token, parent, vector, n_pages, chars, link_chars: summed up by task.

    The vector is the sum modulo 2^63, over pages, of a hash of the page and the token's number there. Sums don't
    depend on how pages are dealt, and a page that is there twice counts twice for all of its tokens.
    """
    schema = "host string, kind int, token bigint, parent bigint, vector bigint, n_pages bigint, chars bigint, link_chars bigint"
    kinds = pa.schema([("host", pa.string()), ("kind", pa.int32()), *[(c, pa.int64()) for c in ("token", "parent", "vector", "n_pages", "chars", "link_chars")]])

    def table(sums: dict) -> pa.RecordBatch:
        rows = [(*k, *v) for k, v in sums.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list[int]] = {}
        for b in batches:
            for page_id, url, source in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html"), strict=True):
                host, page = host_of(url), Page(source.as_py() or "")
                seed = (page_id or 0) & (2**64 - 1)
                sums.setdefault((host, 0, 0), [0, 0, 0, 0, 0])[2] += 1
                chars: dict[int, list[int]] = {}
                texts: dict[tuple[int, int], int] = {}
                for context, _, raw, link, _, _, slot, _ in page.fragments:
                    if raw.strip():
                        c = chars.setdefault(slot, [0, 0])
                        c[0] += len(raw)
                        c[1] += len(raw) * link
                        key = (fragment_token(context, raw), context)
                        texts[key] = texts.get(key, 0) + 1
                found = [(1, t, parent, times) for t, (times, parent) in page.tags.items()] + [(2, t, c, k) for (t, c), k in texts.items()]
                for kind, token, parent, times in found:
                    s = sums.setdefault((host, kind, token), [parent, 0, 0, 0, 0])
                    s[1] = (s[1] + (xxhash.xxh64_intdigest(times.to_bytes(8, "little"), seed) >> 1)) % 2**63
                    s[2] += 1
                    if kind == 1 and token in chars:
                        s[3] += chars[token][0]
                        s[4] += chars[token][1]
                if len(sums) > 200_000:
                    yield table(sums)
                    sums = {}
        if sums:
            yield table(sums)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(of_batches, schema)
    # Two sums of 32 and of 31 bits, so that none overflows.
    low, high = F.col("vector").bitwiseAND(2**32 - 1), F.shiftright("vector", 32)
    out = rows.groupBy("host", "kind", "token").agg(
        F.max("parent").alias("parent"), F.sum(low).alias("low"), F.sum(high).alias("high"), F.sum("n_pages").alias("n_pages"), F.sum("chars").alias("chars"), F.sum("link_chars").alias("link_chars")
    )
    high = (F.col("high") + F.shiftright("low", 32)) % 2**31
    return out.withColumn("vector", F.shiftleft(high, 32) + F.col("low").bitwiseAND(2**32 - 1)).drop("low", "high")


def templates(counted: DataFrame) -> DataFrame:
    """host, n_pages, tags (contexts of the template's tags), texts (its own text), link_slots (contexts full of links)."""
    counted = written(counted.where(f"kind = 0 or n_pages >= {MIN_PAGES}"), "counted")
    hosts = counted.where("kind = 0").select("host", F.col("n_pages").alias("of"))
    total = hosts.agg(F.sum("of")).first()[0] or 0
    tokens = left_join_groups(counted.where("kind > 0"), hosts.withColumn("size", F.col("of")), "host", "size", total).where(F.col("n_pages") >= F.greatest(F.least(F.lit(FEW_PAGES), "of"), MIN_SHARE * F.col("of")))
    classes = tokens.groupBy("host", "vector").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("least")).where("n > 1 and least = 1")
    valid = tokens.join(classes.select("host", "vector"), ["host", "vector"], "left_semi")
    tags = valid.where("kind = 1").select("host", F.col("token").alias("parent"))
    nested = valid.where("parent = 0").unionByName(valid.where("parent <> 0").join(tags, ["host", "parent"], "left_semi"))
    linked = F.col("link_chars") > LINK_SHARE * F.col("chars")
    return nested.groupBy("host").agg(
        F.max("of").alias("n_pages"),
        F.collect_set(F.when(F.col("kind") == 1, F.col("token"))).alias("tags"),
        F.collect_set(F.when(F.col("kind") == 2, F.col("token"))).alias("texts"),
        F.collect_set(F.when((F.col("kind") == 1) & linked, F.col("token"))).alias("link_slots"),
    )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    small_batches(pages.sparkSession)
    found = written(templates(occurrences(pages)), "templates")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    schema = "page_id bigint, url string, text string, n_chars bigint"

    def texts(b: pa.RecordBatch, template_of) -> pa.RecordBatch:
        out = []
        for url, source in zip(b.column("url").to_pylist(), b.column("html"), strict=True):
            out.append(Page(source.as_py() or "").text(*(template_of(url) or NO_TEMPLATE)))
        return pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )

    size = found.agg(F.sum(F.size("tags") + F.size("texts") + F.size("link_slots"))).first()[0] or 0
    if size <= BROADCAST_TOKENS:
        shared = spark.sparkContext.broadcast({r.host: (frozenset(r.tags), frozenset(r.texts), frozenset(r.link_slots)) for r in found.collect()})

        def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield texts(b, lambda url: shared.value.get(host_of(url)))

        return rows.mapInArrow(of_batches, schema)

    def of_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = iter([tuple(frozenset(x or ()) for x in t) for t in zip(*[b.column(c).to_pylist() for c in ("tags", "texts", "link_slots")], strict=True)])
            yield texts(b, lambda url, sets=sets: next(sets))

    def with_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("host", pa.array([host_of(u) for u in b.column("url").to_pylist()], pa.string()))

    total = pages.count()
    joined = left_join_groups(rows.mapInArrow(with_host, "page_id bigint, url string, html string, host string"), found, "host", "n_pages", total)
    return joined.select("page_id", "url", "html", "tags", "texts", "link_slots").mapInArrow(of_joined, schema)


NO_TEMPLATE: tuple[frozenset[int], ...] = (frozenset(), frozenset(), frozenset())


def op3_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
