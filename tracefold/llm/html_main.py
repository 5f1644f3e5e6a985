"""HTML extraction: the main text of pages.

Pages are cut into blocks of text, each with a zone: main (inside an article), boilerplate (inside navigation, headers, footers, asides, forms, or elements whose
class, id or role says so), or open. A class or id marks weakly: an article inside such an element is main all the same, unless it lies in another article or the page
has an article outside. Long token runs that repeat across pages of a host are boilerplate as well: each task builds the suffix array of
its pages' token streams (all zones; prefix doubling to ``RUN`` tokens, streams concatenated with separators, the host part of each token) and
reports its intervals with the number of pages they occur on; Spark sums them by host and run, so the host with a third of all pages is never
in one task. So that few runs are shuffled whole, ``PREFIX`` bits of each are counted first, packed, and a bitmap of those on enough pages is tested
before the exact sums. The zone is where a page starts from (its main blocks, or the open ones where it has none); of these, the blocks mostly covered by repeated
runs are removed. An article that is itself mostly repeated is a copy, not boilerplate, and stays; whole blocks too short for a run are evidence against
open blocks only.

Defined cases: null and empty html give an empty text; malformed markup is read as browsers do (unclosed elements end with
their parents); character references are decoded, also those cut short; repeated rows are pages of their own; a null url is a host of its own.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import bytes as B
from tracefold.llm.common import stored, table

U64 = np.uint64
#: Tokens of the repeated runs (a shorter block is a run of its own), and pages of a host that make a run boilerplate.
RUN, MIN_PAGES = 8, 3
#: Share of a block's tokens that repeated runs must cover for its removal; an article of which they cover as much is a copy.
COVERED = 0.5
#: Bytes of block text whose streams are worked on at once.
PIECE = 4 * B.CHUNK
#: Bits of a run's name that choose its packet, and with the 32 after them are counted before the exact sums; most bits of the bitmap (beyond, more runs pass).
PACKET, PREFIX, MOST_BITS = 10, 42, 28
OPEN, MAIN, BOILERPLATE = 0, 1, 2
#: Pages with removed blocks up to which these are broadcast; more are shuffled.
MAX_BROADCAST = 200_000
#: While a page is parsed: boilerplate by class or id only, and an article inside it.
MARKED, NESTED = 3, 4

# Element names and the words of class, id and role that mark boilerplate.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
HIDDEN = frozenset("script style noscript template iframe svg canvas math head title select textarea button object audio video datalist".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDES = frozenset("nav footer aside form menu dialog".split())
MARKS = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar comment comments commentlist disqus respond reply replies discussion share sharing social related recommended nav navbar navigation menu breadcrumb breadcrumbs footer masthead newsletter subscribe subscription signup popup modal overlay widget widgets toolbar pagination pager skip skiplink".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_PART = re.compile(r"[^a-z0-9]+")


def _marked(name: str, attrs: str, inside_main: bool) -> int:
    """BOILERPLATE, MARKED where only a class or id says so, or OPEN."""
    if name in ASIDES or (name == "header" and not inside_main):
        return BOILERPLATE
    if not attrs:
        return OPEN
    mark = OPEN
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id") and not MARKS.isdisjoint(_PART.split(value)) and name not in ("html", "body"):
            mark = MARKED
        if key == "role" and value in ROLES or key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return BOILERPLATE
    return mark


def page_blocks(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of the blocks in page order, without empty ones."""
    if not page:
        return []
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int, bool]] = []  # name, zone, hidden
    zone, hidden = OPEN, False
    outside = False  # an article that no marked element holds has text
    parts: list[str] = []
    pos, n = 0, len(page)

    def close() -> None:
        nonlocal outside
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((zone, text))
                outside = outside or (zone == MAIN and any(s[0] == "article" for s in stack))

    def pop(to: int) -> None:
        nonlocal zone, hidden
        del stack[to:]
        zone, hidden = (stack[-1][1], stack[-1][2]) if stack else (OPEN, False)

    while pos < n:
        m = _TAG.search(page, pos)
        text = page[pos : m.start()] if m else page[pos:]
        if text and not hidden:
            parts.append(text)
        if not m:
            break
        pos = m.end()
        name = m[2]
        if not name:
            if not hidden and parts and not m[0].startswith("<!--"):
                parts.append(" ")
            continue
        name = name.lower()
        if m[1]:
            if name in BLOCKS:
                close()
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if at >= 0 and (name in BLOCKS or not any(s[0] in BLOCKS for s in stack[at + 1 :])):
                close()
                pop(at)
            continue
        if name == "br" or name in VOID:
            if not hidden:
                parts.append(" ")
            if name == "hr":
                close()
            continue
        if name in BLOCKS:
            close()
            if stack and stack[-1][0] == "p":
                pop(len(stack) - 1)
            if name in ("li", "td", "th", "tr", "dd", "dt", "option") and stack and stack[-1][0] == name:
                pop(len(stack) - 1)
        if m[3].endswith("/") and name not in BLOCKS:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, pos)
            pos = end.end() if end else n
            if not hidden:
                parts.append(" ")
            continue
        is_hidden = hidden or name in HIDDEN
        inner = zone
        if zone != BOILERPLATE:
            mark = _marked(name, m[3], zone in (MAIN, NESTED))
            if mark == MARKED and any(s[0] == "article" for s in stack):
                mark = BOILERPLATE
            if mark:
                inner = mark
            elif name in ("article", "main"):
                inner = NESTED if zone in (MARKED, NESTED) else MAIN
        if name in BLOCKS or is_hidden or inner != zone:
            if inner != zone:
                close()
            stack.append((name, inner, is_hidden))
            zone, hidden = inner, is_hidden
    close()
    final = {MARKED: BOILERPLATE, NESTED: BOILERPLATE if outside else MAIN}
    return [(final.get(z, z), t) for z, t in out]


PARSED = "rid long, host string, zones array<int>, texts array<string>"


def _parse():
    schema = pa.schema([("rid", pa.int64()), ("host", pa.string()), ("zones", pa.list_(pa.int32())), ("texts", pa.list_(pa.string()))])

    def run(batches):
        for rows, _, _ in B.chunks(batches, "html"):
            col = lambda c: rows.column(rows.schema.get_field_index(c))  # noqa: B023, E731
            pages = [page_blocks(page) for page in col("html").to_pylist()]
            zones, texts = [[z for z, _ in p] for p in pages], [[t for _, t in p] for p in pages]
            yield B.record(schema, col("rid"), col("host"), pa.array(zones, schema.field("zones").type), pa.array(texts, schema.field("texts").type))

    return run


def stream(hosts: list[str], texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all blocks (hashed with their host), their page and their block, block after block."""
    flat = [t for page in texts for t in page]
    page = np.repeat(np.arange(len(texts)), [len(p) for p in texts])
    raw, offs = B.text_bytes(pa.array(flat, pa.string()))
    starts, ends, bounds = B.word_spans(raw, offs)
    block = np.repeat(np.arange(len(flat)), np.diff(bounds))
    hraw, hoffs = B.text_bytes(pa.array(hosts, pa.string()))
    host = B.span_hashes(hraw, hoffs[:-1], hoffs[1:])
    with np.errstate(over="ignore"):
        token = B.mix(B.span_hashes(raw, starts, ends) + host[page[block]]) if len(block) else np.empty(0, U64)
    return token, page[block] if len(block) else block, block


def run_ranks(token: np.ndarray, block: np.ndarray, width: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the streams cut at ``width`` tokens, by prefix doubling; blocks end in their own separator.

    Returns the suffixes in order and each suffix's rank; equal ranks are one interval of common prefix ``width`` (or one whole short block).
    """
    n = len(token)
    rank = np.unique(token, return_inverse=True)[1].astype(np.int64) + 1
    have = 1
    while have < width:
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: n - have] = np.where(block[have:] == block[: n - have], rank[have:], 0)
        rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)[1].astype(np.int64) + 1
        have *= 2
    return np.argsort(rank, kind="stable"), rank


def _names(token: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and global names of the runs: full ones, and whole blocks of fewer tokens."""
    n = len(token)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U64)
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    end = np.repeat(np.r_[first[1:], n], np.diff(np.r_[first, n]))
    length = np.minimum(RUN, end - np.arange(n))
    starts = np.flatnonzero((length == RUN) | np.isin(np.arange(n), first))
    name = np.zeros(len(starts), dtype=U64)
    with np.errstate(over="ignore"):
        for i in range(RUN):
            live = length[starts] > i
            name[live] = B.mix(name[live] * U64(0x2545F4914F6CDD1D) + token[starts[live] + i] + U64(1))
    return starts, length[starts], name


def _pieces(batches):
    """The batches cut after about ``PIECE`` bytes of text (one larger page is worked on alone)."""
    for batch in batches:
        sizes = [sum(map(len, page)) for page in batch.column(batch.schema.get_field_index("texts")).to_pylist()]
        begin = held = 0
        for i, size in enumerate(sizes):
            if i > begin and held + size > PIECE:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        if begin < batch.num_rows:
            yield batch.slice(begin)


def _packets(min_pages: int):
    """Per piece and packet: the prefixes of its intervals, each as often as it has pages (at most ``min_pages`` times), sorted, byte by byte."""
    schema = pa.schema([("packet", pa.int32()), ("prefixes", pa.binary())])

    def run(batches):
        for batch in _pieces(batches):
            hosts = [h or "" for h in batch.column(batch.schema.get_field_index("host")).to_pylist()]
            token, page, block = stream(hosts, batch.column(batch.schema.get_field_index("texts")).to_pylist())
            if not len(token):
                continue
            starts, _, name = _names(token, block)
            _, rank = run_ranks(token, block)
            # pages of each interval: distinct (rank, page) pairs
            pairs = np.unique(rank[starts] * batch.num_rows + page[starts])
            ranks, pages = np.unique(pairs // batch.num_rows, return_counts=True)
            some = np.zeros(int(rank.max()) + 1, dtype=U64)
            some[rank[starts]] = name
            prefix = np.sort(np.repeat(some[ranks] >> U64(64 - PREFIX), np.minimum(pages, min_pages)))
            packet = (prefix >> U64(32)).astype(np.int64)
            cuts = np.searchsorted(packet, np.arange((1 << PACKET) + 1))
            some_in = np.flatnonzero(np.diff(cuts))
            yield B.record(schema, some_in.astype(np.int32), pa.array([prefix[cuts[i] : cuts[i + 1]].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for i in some_in], pa.binary()))

    return run


def _frequent(min_pages: int):
    """The prefixes of a packet that pieces name ``min_pages`` times."""

    def run(part: pa.Table) -> pa.Table:
        values = [np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel() for x in part.column("prefixes").to_pylist()]
        value, times = np.unique(np.concatenate(values), return_counts=True)
        packet = part.column("packet")[0].as_py()
        return pa.table({"prefix": pa.array((packet << 32) + value[times >= min_pages].astype(np.int64), pa.int64())})

    return run


def _bitmap(prefixes: DataFrame):
    """A broadcast bitmap of the prefixes' leading bits, some 32 for each prefix up to ``MOST_BITS``, and the number of leading bits."""
    bits = min(MOST_BITS, max(10, (32 * prefixes.count()).bit_length()))
    at = F.shiftright("prefix", PREFIX - bits)
    words = prefixes.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftright(prefix, {PREFIX - bits}) & 63 AS INT))")).alias("cell")).toArrow()
    cells = np.zeros(1 << (bits - 6), dtype=np.int64)
    cells[words.column("word").to_numpy()] = words.column("cell").to_numpy()
    return prefixes.sparkSession.sparkContext.broadcast(cells), bits


def _passes(name: np.ndarray, cells: np.ndarray, bits: int) -> np.ndarray:
    at = name >> U64(64 - bits)
    return (cells.view(U64)[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1


def _intervals(cells, bits: int):
    schema = pa.schema([("run", pa.int64()), ("pages", pa.int64())])

    def run(batches):
        for batch in _pieces(batches):
            hosts = [h or "" for h in batch.column(batch.schema.get_field_index("host")).to_pylist()]
            token, page, block = stream(hosts, batch.column(batch.schema.get_field_index("texts")).to_pylist())
            if not len(token):
                continue
            starts, _, name = _names(token, block)
            use = _passes(name, cells.value, bits)
            name, runs = np.unique(name[use], return_inverse=True)
            pairs = np.unique(runs * batch.num_rows + page[starts[use]])
            runs, pages = np.unique(pairs // batch.num_rows, return_counts=True)
            yield B.record(schema, name[runs].view(np.int64), pages)

    return run


def _windows(cells, bits: int):
    schema = pa.schema([("rid", pa.int64()), ("block", pa.int32()), ("at", pa.int32()), ("len", pa.int32()), ("size", pa.int32()), ("article", pa.int32()), ("run", pa.int64())])

    def run(batches):
        for batch in _pieces(batches):
            col = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
            texts, zones, rid = col("texts"), col("zones"), np.array(col("rid"), dtype=np.int64)
            token, page, block = stream([h or "" for h in col("host")], texts)
            starts, length, name = _names(token, block)
            if not len(starts):
                continue
            zone = np.array([z for p in zones for z in p])
            number = np.concatenate([np.arange(len(p)) for p in texts])
            begin = np.searchsorted(block, block[starts])
            size = np.bincount(block, minlength=len(zone))
            # tokens of each page's article; a page that has one is judged by its main blocks, another by its open ones
            article = np.bincount(page[zone[block] == MAIN], minlength=len(texts))
            at = zone[block[starts]]
            use = np.where(article[page[starts]] > 0, (at == MAIN) & (length == RUN), at == OPEN) & _passes(name, cells.value, bits)
            b = block[starts][use]
            yield B.record(schema, rid[page[starts]][use], number[b].astype(np.int32), (starts - begin)[use].astype(np.int32), length[use].astype(np.int32), size[b].astype(np.int32), article[page[starts]][use].astype(np.int32), name[use].view(np.int64))

    return run


def main_text(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """Per row: ``key, url, text`` (blocks joined by a newline)."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"://([^/?#]*)", 1))
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(key_col).alias("key"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    # the key and url ride along in the stored rows: rid only names rows within them
    schema = "key {}, url string, ".format(rows.schema["key"].dataType.simpleString()) + PARSED
    keep = stored(rows.mapInArrow(_with(_parse()), schema), "html-blocks")
    pieces = keep.select("host", "texts")
    prefixes = stored(pieces.mapInArrow(_packets(min_pages), "packet int, prefixes binary").groupBy("packet").applyInArrow(_frequent(min_pages), "prefix long"), "html-prefixes")
    cells, bits = _bitmap(prefixes)
    runs = pieces.mapInArrow(_intervals(cells, bits), "run long, pages long").groupBy("run").agg(F.sum("pages").alias("pages")).where(F.col("pages") >= min_pages).select("run")
    runs = stored(runs, "html-runs")  # a table of its own, so that Spark can split the windows of a run that is everywhere
    seen = keep.select("rid", "host", "zones", "texts").mapInArrow(_windows(cells, bits), "rid long, block int, at int, len int, size int, article int, run long").join(runs, "run")
    places = F.array_distinct(F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.col("len") - 1))))
    covered = seen.groupBy("rid", "block", "size", "article").agg(F.size(places).alias("n"))
    found = covered.groupBy("rid", "article").agg(F.collect_set(F.when(F.col("n") >= COVERED * F.col("size"), F.col("block"))).alias("gone"), F.sum("n").alias("n"))
    found = stored(found.where((F.col("article") == 0) | (F.col("n") < COVERED * F.col("article"))).where(F.size("gone") > 0).select("rid", "gone"), "html-gone")
    if found.count() <= MAX_BROADCAST:
        found = F.broadcast(found)
    blocks = F.arrays_zip(F.col("zones").alias("zone"), F.col("texts").alias("text"))
    numbered = F.transform(blocks, lambda b, i: F.struct(b["zone"].alias("z"), b["text"].alias("t"), i.alias("i")))
    mine = F.when(F.array_contains("zones", MAIN), MAIN).otherwise(OPEN)
    left = F.filter(numbered, lambda b: (b["z"] == mine) & ~F.array_contains(F.coalesce(F.col("gone"), F.array().cast("array<int>")), b["i"]))
    return keep.join(found, "rid", "left").select("key", "url", F.array_join(F.transform(left, lambda b: b["t"]), "\n").alias("text"))


def _with(parse):
    """``parse`` with the key and url columns put before its own."""

    def run(batches):
        for batch in batches:
            at, names = 0, batch.schema.names
            for out in parse([batch]):
                lead = [batch.column(names.index(c)).slice(at, out.num_rows) for c in ("key", "url")]
                at += out.num_rows
                yield pa.RecordBatch.from_arrays([*lead, *out.columns], names=["key", "url", *out.schema.names])

    return run


def op6_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(table(spark, sf_dir, "pages"))
    return out.select(F.col("key").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op6_html_main": op6_html_main}
SQL: dict[str, str] = {}
