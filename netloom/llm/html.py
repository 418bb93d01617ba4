"""Main text of web pages with a host suffix array (operator 7).

A page is read once into blocks.  Elements that are no content by their tag, role or name (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, comments by readers) are dropped.  If the
page has articles (or a main element), their other blocks are the text: a passage that some pages share is
still part of each article.

The blocks of all articles pass through suffix arrays too.  A run that more than half of a host's different
articles have, ``COMMON`` of them at least, is common; an article's block that common runs cover from end to end is a notice or an
advert without a name, and dropped.  Headings and other blocks of fewer than ``RUN`` tokens stay, and an article that would
lose half of its text stays whole: its fellows are versions of it.  A run common to a host is common in one of
its chunks, so the arrays of the chunks name all that can be, and those are counted over all articles of the host.

Pages without such an element have loose blocks, of which only the host's other pages tell what is
boilerplate.  The tokens of all blocks outside articles, dropped ones too, are concatenated per host, and
a suffix array (prefix doubling up to ``RUN`` tokens) brings equal runs together.  A hot host is cut into
chunks of about ``CHUNK_PAGES`` pages with an array each; runs are then merged over the chunks by their
hash, which makes the result that of one array over the whole host.  Runs on two or more distinct pages
(shorter blocks: as a whole) are boilerplate; tokens they cover are removed from loose blocks, the rest is kept.

Null or empty html: empty text.  Null page ids and urls are passed through; pages without a host are one
host.  Repeated rows are one page: they are not evidence against each other, and get the same text.
Unclosed, crossing or broken tags end with what encloses them.  An empty table gives an empty one.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import row_keys
from netloom.session import broadcast_if_small, materialize, shared_path

#: Tokens of a long run; a power of two.  Pages of a chunk.
RUN, CHUNK_PAGES = 8, 250
#: Articles that have a common run, at least; common runs of all hosts that go to every worker; pages held parsed at once.
COMMON, SENT_RUNS, PARSED_PAGES = 10, 4_000_000, 1_000
#: Of the hash of a run, a polynomial of its words' hashes.
FACTOR = np.uint64(0x9E3779B97F4A7C15)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED_TAGS = RAW | frozenset("head nav header footer aside form button select option dialog menu svg canvas audio video object applet datalist".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs header "
    "masthead footer cookie cookies consent gdpr notice notices newsletter subscribe signup popup modal overlay share sharing social related recommended comment comments "
    "disqus reply replies respond widget toolbar pagination pager login search skip".split())
#: What may stand beside a name in a class of several parts without changing its meaning.
NEUTRAL = frozenset("main primary secondary top bottom left right container wrapper box bar area block section inner outer list item items link links".split())
#: A page's frame and its article may be named after what stands beside them.
FRAME = frozenset(["html", "body", "main", "article"])
READERS = frozenset("comment comments reply replies related recommended".split())
ARTICLE, LOOSE, DROPPED = 2, 1, 0

PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\x20\x09-\x0D/>]*)((?:=[\x20\x09-\x0D]*\"[^\"]*(?:\"|\Z)|=[\x20\x09-\x0D]*'[^']*(?:'|\Z)|[^>])*+)(?:>|\Z)|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def _tells(name: str) -> bool:
    """Whether a class or id names what is dropped: as a whole, by its last part, or by its first beside neutral ones."""
    parts = [p for p in re.split("[_-]+", name) if p]
    if not parts:
        return False
    return name in DROPPED_NAMES or parts[-1] in DROPPED_NAMES or parts[0] in DROPPED_NAMES and NEUTRAL.issuperset(parts[1:])


def _dropped(tag: str, attributes: str) -> bool:
    if tag in DROPPED_TAGS:
        return True
    if not attributes or attributes.isspace():
        return False
    named = {}
    for m in ATTRIBUTE.finditer(attributes):
        named.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    names = f"{named.get('class', '')} {named.get('id', '')}".lower().split()
    if tag in FRAME:
        return tag == "article" and bool({p for n in names for p in re.split("[_-]+", n)} & READERS)
    return (any(map(_tells, names)) or named.get("role", "").lower() in DROPPED_ROLES or "hidden" in named
            or named.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(named.get("style", ""))))


def blocks(page: str) -> list[tuple[int, str]]:
    """``(kind, text)`` of every block with text, in page order."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements, and the kind their text had before
    opened: Counter[str] = Counter()  # how many of each are open: what closes nothing is not looked for
    kind, at = LOOSE, 0

    def flush() -> None:
        if not held:
            return
        text = SPACE.sub(" ", "".join(held)).strip(" ")
        held.clear()
        if text:
            out.append((kind, text))

    while m := PIECE.match(page, at):
        at = m.end()
        if m[4] is not None:
            held.append(html.unescape(m[4]))
            continue
        if m[2] is None:  # a comment or declaration
            continue
        tag = m[2].lower()
        if tag not in INLINE:
            flush()
        if m[1]:
            if opened[tag]:
                while (closed := stack.pop())[0] != tag:
                    opened[closed[0]] -= 1
                opened[tag] -= 1
                if closed[1] != kind:
                    flush()
                kind = closed[1]
            continue
        if tag in VOID or m[3].endswith("/") and tag not in RAW:
            continue
        if tag in RAW:  # its content is no markup
            end = re.compile(rf"</{re.escape(tag)}(?=[\x20\x09-\x0D/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
        if tag == "p" and any(t == "p" for t, _ in stack[-8:]):  # a paragraph ends the one before
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] not in INLINE and stack[depth][0] != "p":
                    break
                if stack[depth][0] == "p":
                    kind = stack[depth][1]
                    opened.subtract(t for t, _ in stack[depth:])
                    del stack[depth:]
                    break
        stack.append((tag, kind))
        opened[tag] += 1
        before = kind
        if kind != DROPPED:
            if _dropped(tag, m[3]):
                kind = DROPPED
            elif tag in ("article", "main"):
                kind = ARTICLE
        if kind != before and tag in INLINE:  # text before it has the kind before
            kind, now = before, kind
            flush()
            kind = now
    flush()
    return out


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))


_word = lru_cache(maxsize=100_000)(_hash)


def _hashed_runs(words: list[str], run: int) -> np.ndarray:
    """The hash of each full run of the words."""
    count = max(len(words) - run + 1, 0)
    one = np.array([_word(w) for w in words], np.uint64)
    out = np.zeros(count, np.uint64)
    for at in range(run):
        out = out * FACTOR + one[at:at + count]
    return out.view(np.int64)


def _stream(texts: list[str]) -> list[str]:
    """The words of the blocks, an empty word behind each block: no run of words goes on into the next."""
    return [w for t in texts for w in (*t.split(" "), "")]


def without_notices(found: list[tuple[int, str]], common: np.ndarray, run: int) -> list[tuple[int, str]]:
    """The blocks of a page, those of its articles that common runs cover marked as dropped."""
    own = [i for i, (k, _) in enumerate(found) if k == ARTICLE]
    if not len(common) or not own:
        return found
    words = _stream([found[i][1] for i in own])
    hit = np.isin(_hashed_runs(words, run), common)
    bare = np.ones(len(words), bool)
    for at in range(run):
        bare[at:at + len(hit)] &= ~hit
    ends = np.flatnonzero([w == "" for w in words])
    bare[ends] = False
    left = np.add.reduceat(bare, np.append(0, ends[:-1] + 1), dtype=np.int64)
    gone = {i for i, n in zip(own, left, strict=True) if not n}
    if 2 * sum(len(found[i][1]) for i in gone) >= sum(len(found[i][1]) for i in own):
        return found
    return [(DROPPED if i in gone else k, t) for i, (k, t) in enumerate(found)]


class _RunsOf(dict):
    """The runs of each host, out of an array with those of every row's host."""

    def __init__(self, hosts: pa.Array, runs: pa.Array):
        super().__init__()
        for i, host in enumerate(hosts.to_pylist()):
            if host not in self:
                self[host] = np.array(runs[i].as_py() or (), np.int64)


def _parsed(page: Column, host: Column, candidates: Column, run: int) -> Column:
    """A hash of the articles, which candidates for common runs they have, and the kinds and texts of the blocks outside articles.

    Of a page that has loose blocks, the articles' blocks are among them too.
    """
    @F.arrow_udf("struct<article:long,at:array<int>,kinds:array<int>,others:array<string>>")
    def parse(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pages, hosts, runs in batches:
            article, at, kinds, others = [], [], [], []
            known = _RunsOf(hosts, runs)
            for page, host in zip(pages.to_pylist(), hosts.to_pylist(), strict=True):
                found = blocks(page or "")
                texts = [t for k, t in found if k == ARTICLE]
                article.append(_article(texts))
                at.append(np.flatnonzero(np.isin(known[host], _hashed_runs(_stream(texts), run))) if len(known[host]) else ())
                judged = found if any(k == LOOSE for k, _ in found) else [(k, t) for k, t in found if k != ARTICLE]
                kinds.append([k for k, _ in judged])
                others.append([t for _, t in judged])
            yield pa.StructArray.from_arrays([pa.array(article, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(kinds, pa.list_(pa.int32())), pa.array(others, pa.list_(pa.string()))],
                                             ["article", "at", "kinds", "others"])

    return parse(page, host, candidates)


def _article(texts: list[str]) -> int:
    return _hash("\n".join(texts)) >> 1


def _article_text(page: Column, host: Column, common: Column, run: int) -> Column:
    """The text of the articles; null for a page that has loose blocks."""
    @F.arrow_udf("string")
    def text(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pages, hosts, runs in batches:
            out = []
            known = _RunsOf(hosts, runs)
            for page, host in zip(pages.to_pylist(), hosts.to_pylist(), strict=True):
                found = blocks(page or "")
                loose = any(k == LOOSE for k, _ in found)
                out.append(None if loose else " ".join(t for k, t in without_notices(found, known[host], run) if k == ARTICLE))
            yield pa.array(out, pa.string())

    # not deterministic only in name: a filter on the result would otherwise read each page once more
    return text.asNondeterministic()(page, host, common)


def _kinds_without_notices(kinds: Column, texts: Column, host: Column, common: Column, run: int) -> Column:
    @F.arrow_udf("array<int>")
    def without(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for kinds, texts, hosts, runs in batches:
            known = _RunsOf(hosts, runs)
            pages = zip(kinds.to_pylist(), texts.to_pylist(), hosts.to_pylist(), strict=True)
            yield pa.array([[k for k, _ in without_notices(list(zip(ks, ts, strict=True)), known[host], run)] for ks, ts, host in pages], pa.list_(pa.int32()))

    return without(kinds, texts, host, common)


def suffix_order(tokens: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by the ``run`` tokens from there on, and the rank of each position; equal runs rank alike."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < run:
        after = np.append(rank[width:] + 1, np.zeros(min(width, len(rank)), np.int64))
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64)
        width *= 2
    return np.argsort(rank, kind="stable"), rank


def _ranked_runs(words: list[list[str]], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of the blocks in suffix order: their block, position and length, and a key, alike for equal runs.

    A run is a stretch of full length, or a shorter block as a whole.
    """
    ids: dict[str, int] = {}
    sizes = np.array([len(w) for w in words], np.int64)
    # the token stream, each block followed by as many end marks as a run has tokens: no run sees the next block
    ends = [0] * run
    stream = np.array([i for w in words for i in (*(ids.setdefault(t, len(ids) + 1) for t in w), *ends)], np.int64)
    block = np.repeat(np.arange(len(words)), sizes + run)
    pos = np.arange(len(stream)) - np.repeat(np.cumsum(sizes + run) - sizes - run, sizes + run)
    left = sizes[block] - pos
    order, rank = suffix_order(stream, run)
    fits = ((left >= run) | ((pos == 0) & (left > 0)))[order]
    order = order[fits]
    key = np.cumsum(np.diff(rank[order], prepend=-1) != 0) - 1
    return block[order], pos[order], np.minimum(left, run)[order], key


def _host_runs(run: int):
    """The distinct runs of a chunk of a host with the number of its pages that have each, and where loose blocks have them."""
    schema = pa.schema([("run", pa.int64()), ("check", pa.int64()), ("pages", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("block", pa.int32()), ("pos", pa.int32()), ("size", pa.int32())])

    def runs(table: pa.Table) -> pa.Table:
        words = [SPACE.split(t) for t in table["text"].to_pylist()]
        block, pos, length, key = _ranked_runs(words, run)
        if not len(key):
            return schema.empty_table()
        first = np.flatnonzero(np.diff(key, prepend=-1))
        texts = [" ".join(words[block[i]][pos[i]:pos[i] + length[i]]).encode("utf-8", "replace") for i in first]
        hashed = np.array([xxhash.xxh3_128_intdigest(t) for t in texts], object)
        run_id, check = (np.array([int(h >> s) & (1 << 64) - 1 for h in hashed], np.uint64).view(np.int64) for s in (0, 64))
        page = np.unique(table["page"].to_numpy(zero_copy_only=False), return_inverse=True)[1]
        pairs = np.unique(np.stack([key, page[block]], 1), axis=0)
        pages = np.bincount(pairs[:, 0], minlength=len(first))
        loose = np.flatnonzero(table["loose"].to_numpy(zero_copy_only=False)[block])
        of = key[loose]
        nulls = [None] * len(first)
        rows = block[loose]
        found = pa.table([pa.array(run_id), pa.array(check), pa.array(pages), *(pa.array(nulls, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], schema=schema)
        places = pa.table([pa.array(run_id[of]), pa.array(check[of]), pa.array(np.zeros(len(of), np.int64)), table["k1"].take(pa.array(rows)), table["k2"].take(pa.array(rows)),
                           table["block"].take(pa.array(rows)), pa.array(pos[loose].astype(np.int32)), pa.array(length[loose].astype(np.int32))], schema=schema)
        return pa.concat_tables([found, places])

    return runs


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    keys = row_keys(F.col("page_id"), F.col("html"), F.col("url"))
    return pages.select("page_id", "url", "html", host.alias("host"), *keys)


def _articles(pages: DataFrame, run: int) -> DataFrame:
    """``host, chunk, chunks, article, texts``: the blocks of ``run`` words or more of each host's different articles.

    An article stands for all its copies on the host, except that each task may find it again.
    """
    def articles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            for start in range(0, batch.num_rows, PARSED_PAGES):
                rows = []
                for row in batch.slice(start, PARSED_PAGES).to_pylist():
                    texts = [t for k, t in blocks(row["html"] or "") if k == ARTICLE]
                    article = _article(texts)
                    if texts and (row["host"], article) not in seen:
                        seen.add((row["host"], article))
                        rows.append((row["host"], article % row["chunks"], row["chunks"], article, [t for t in texts if t.count(" ") + 1 >= run]))
                if rows:
                    columns = (pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())), strict=True))
                    yield pa.RecordBatch.from_arrays(list(columns), ["host", "chunk", "chunks", "article", "texts"])

    return pages.select("host", "chunks", "html").mapInArrow(articles, "host string, chunk long, chunks long, article long, texts array<string>")


def _often(run: int):
    """The number of different articles of a chunk of a host, and the hashes of the runs that more than half of them have."""
    schema = pa.schema([("host", pa.string()), ("articles", pa.int64()), ("run", pa.int64())])

    def often(key: tuple, table: pa.Table) -> pa.Table:
        different, rows = np.unique(table["article"].to_numpy(), return_index=True)
        count, runs = len(different), []
        if count >= COMMON or key[2].as_py() > 1:
            texts = table["texts"].take(pa.array(rows)).to_pylist()
            words = [t.split(" ") for ts in texts for t in ts]
            article = np.repeat(np.arange(count), [len(ts) for ts in texts])
            block, pos, _, keys = _ranked_runs(words, run)
            having = np.bincount(np.unique(keys * count + article[block]) // count)
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            runs = [int(_hashed_runs(words[block[i]][pos[i]:pos[i] + run], run)[0]) for i in first[2 * having > count]]
        return pa.table([pa.array([key[0].as_py()] * (len(runs) + 1), pa.string()), pa.array([count] + [0] * len(runs), pa.int64()), pa.array([None, *runs], pa.int64())], schema=schema)

    return often


def _candidates(pages: DataFrame, run: int, chunk_pages: int) -> DataFrame:
    """``host, articles, runs``: the number of a host's different articles, and the hashes of the runs that can be common there."""
    spark = pages.sparkSession
    different = F.approx_count_distinct(F.xxhash64("html"))
    hosts = pages.groupBy("host").agg(F.greatest(F.ceil(different / chunk_pages), F.lit(1)).cast("long").alias("chunks"))
    articles = _articles(pages.join(broadcast_if_small(materialize(hosts)), "host"), run)
    path = shared_path(spark, "often")
    articles.groupBy("host", "chunk", "chunks").applyInArrow(_often(run), "host string, articles long, run long").write.parquet(path)
    often = spark.read.parquet(path).groupBy("host").agg(F.sum("articles").alias("articles"), F.sort_array(F.collect_set("run")).alias("runs"))
    path = shared_path(spark, "candidates")
    often.filter((F.col("articles") >= COMMON) & (F.size("runs") > 0)).write.parquet(path)
    return spark.read.parquet(path)


def _common(around: DataFrame, candidates: DataFrame) -> DataFrame:
    """``host, runs``: the hashes of the runs that more than half of a host's different articles have, ``COMMON`` of them at least."""
    having = around.filter(F.size("at") > 0).select("host", "article", "at").drop_duplicates(["host", "article"])
    counted = having.select("host", F.explode("at").alias("at")).groupBy("host", "at").count()
    common = counted.join(candidates, "host").filter((F.col("count") >= COMMON) & (2 * F.col("count") > F.col("articles")))
    path = shared_path(around.sparkSession, "common")
    common.groupBy("host").agg(F.collect_list(F.get("runs", F.col("at"))).alias("runs")).write.parquet(path)
    return around.sparkSession.read.parquet(path)


def _with_runs(pages: DataFrame, runs: DataFrame) -> DataFrame:
    few = (runs.agg(F.sum(F.size("runs"))).first()[0] or 0) <= SENT_RUNS
    runs = runs.select("host", "runs")
    return pages.join(F.broadcast(runs) if few else runs, "host", "left")


def _around(pages: DataFrame, run: int) -> DataFrame:
    """Each page with the blocks outside its articles, and the ``runs`` its articles have, parsed and written once."""
    own = F.coalesce(F.col("page_id"), F.col("k2"))
    parsed = pages.select("page_id", "url", "host", "k1", "k2", own.alias("page"), _parsed(F.col("html"), F.col("host"), F.col("runs"), run).alias("x"))
    path = shared_path(pages.sparkSession, "pages")
    parsed.select("page_id", "url", "host", "k1", "k2", "page", "x.article", "x.at", "x.kinds", "x.others").write.parquet(path)
    return pages.sparkSession.read.parquet(path)


def _block_rows(around: DataFrame, *columns: str) -> DataFrame:
    flat = around.select(*columns, F.posexplode(F.arrays_zip("kinds", "others")).alias("block", "b"))
    kind = F.col("b.kinds")
    return flat.select(*columns, "block", kind.alias("kind"), (kind == LOOSE).alias("loose"), F.col("b.others").alias("text"))


def boilerplate_places(around: DataFrame, run: int = RUN, chunk_pages: int = CHUNK_PAGES) -> DataFrame:
    """``k1, k2, block, places``: (position, size) of the runs of loose blocks that other pages of the host have too."""
    hosts = around.groupBy("host").agg(F.ceil(F.count("*") / chunk_pages).alias("chunks"))
    flat = _block_rows(around, "host", "k1", "k2", "page")
    chunk = F.pmod(F.xxhash64("page"), F.col("chunks"))
    chunked = flat.join(broadcast_if_small(hosts), "host").withColumn("chunk", chunk).drop("chunks")

    runs = _host_runs(run)

    def of_chunk(key: tuple, table: pa.Table) -> pa.Table:
        out = runs(table)
        return out.append_column("host", pa.array([key[0].as_py()] * out.num_rows, pa.string()))

    made = chunked.groupBy("host", "chunk").applyInArrow(of_chunk, "run long, check long, pages long, k1 long, k2 long, block int, pos int, size int, host string")
    path = shared_path(around.sparkSession, "runs")
    made.write.parquet(path)
    made = around.sparkSession.read.parquet(path)
    repeated = made.filter("block is null").groupBy("host", "run", "check").agg(F.sum("pages").alias("pages")).filter("pages > 1").drop("pages")
    places = made.filter("block is not null").join(repeated, ["host", "run", "check"])
    return places.groupBy("k1", "k2", "block").agg(F.collect_set(F.struct("pos", "size")).alias("places"))


def _unique_runs(text: Column, places: Column) -> Column:
    """What the places leave of a block."""
    @F.arrow_udf("string")
    def unique(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, covers in batches:
            out = []
            for text, cover in zip(texts.to_pylist(), covers.to_pylist(), strict=True):
                words = SPACE.split(text)
                stay = np.ones(len(words), bool)
                for p in cover or ():
                    stay[p["pos"]:p["pos"] + p["size"]] = False
                out.append(" ".join(w for w, s in zip(words, stay, strict=True) if s))
            yield pa.array(out, pa.string())

    return unique(text, places)


def main_text(pages: DataFrame, run: int = RUN, chunk_pages: int = CHUNK_PAGES) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``."""
    known = _with_host(pages)
    candidates = _candidates(known, run, chunk_pages)
    around = _around(_with_runs(known, candidates), run)
    common = _common(around, candidates)
    places = boilerplate_places(around, run, chunk_pages)
    has_loose = F.array_contains("kinds", LOOSE)
    kinds = _kinds_without_notices(F.col("kinds"), F.col("others"), F.col("host"), F.col("runs"), run)
    mixed = _with_runs(around.filter(has_loose).drop_duplicates(["k1", "k2"]), common).withColumn("kinds", kinds)
    each = _block_rows(mixed, "k1", "k2").filter(F.col("kind") != DROPPED)
    judged = F.when(F.col("loose"), _unique_runs(F.col("text"), F.col("places"))).otherwise(F.col("text"))
    kept = each.join(places, ["k1", "k2", "block"], "left").select("k1", "k2", "block", "loose", judged.alias("t")).filter("t != ''")
    joined = kept.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("block", "loose", "t"))).alias("ts"))

    def size(loose: bool) -> Column:
        return F.aggregate(F.filter("ts", lambda b: b["loose"] == loose), F.lit(0), lambda n, b: n + F.length(b["t"]))

    # an article that is less than what is the page's own beside it is a teaser, not the main text
    main = F.when((size(False) > 0) & (size(False) >= size(True)), F.filter("ts", lambda b: ~b["loose"])).otherwise(F.col("ts"))
    text = F.coalesce(F.array_join(F.transform(main, lambda b: b["t"]), " "), F.lit(""))
    loose = around.filter(has_loose).join(joined, ["k1", "k2"], "left").select("page_id", "url", text.alias("text"))
    # the text of pages without loose blocks is not held anywhere in between: they are read again
    articles = _article_text(F.col("html"), F.col("host"), F.col("runs"), run)
    whole = _with_runs(known, common).select("page_id", "url", articles.alias("text")).filter("text is not null")
    return whole.union(loose).withColumn("n_chars", F.length("text").cast("long"))
