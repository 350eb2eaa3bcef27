"""Main text of web pages: block structure, and a suffix array over each host's token streams.

A page is cut into blocks. What stands in an article or main element is text, but for comments, adverts, forms and the
like inside it, which its elements, roles or names declare. The blocks around it are judged by their host: their token
streams, page after page, are put end to end, with a token of its own between blocks, and sorted into a suffix array;
suffixes whose common prefix has RUN tokens and more stand together there, and where such a group comes from at least
PAGES distinct pages, it is a run that the host repeats. A block that such runs cover (or, if shorter, that recurs whole
on as many pages) is boilerplate; the unique ones stay, on pages that declare no main text, unless their markup
declares them a menu, footer, advert or the like. `boilerplate` gives the blocks that the suffix array removes.

A host with many pages is cut into shards by page: each counts the pages of its runs and blocks by hash, the counts are
summed over the host, and the sums decide.

Defined cases: null or empty html gives an empty text; an unclosed element ends with its page or at the next article;
null urls share one host; rows repeat, null ids and clashing extra columns are carried along or not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm._bytes import span_hashes, text_bytes, window_hashes, words
from tagweave.llm._store import drop_written, written

RUN, PAGES, SHARD_PAGES = 8, 3, 2000
MOST_BIG_HOSTS = 1_000_000

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>?|<[!?][^>]*+>?", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|style|aria-hidden|hidden)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.I)
#: Elements of HTML by their part in a page.
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "xmp", "noembed"}
_ASIDE = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset", "audio", "video", "canvas"}
_MAIN = {"article", "main"}
_BLOCK = {
    "p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "table", "caption", "thead", "tbody", "tfoot", "tr", "blockquote", "pre",
    "section", "article", "main", "header", "footer", "nav", "aside", "figure", "figcaption", "hr", "address", "details", "summary", "form", "fieldset", "body", "html",
}
_CELL = {"br", "td", "th", "option", "wbr", "img"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "wbr", "source", "track", "area", "base", "col", "embed", "param"}
#: Words of class and id names that say what stands beside the text, and words that may go with them.
_BESIDE = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs",
    "footer", "sidebar", "aside", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "comment",
    "comments", "reply", "replies", "respond", "disqus", "share", "sharing", "social", "related", "recommended", "widget", "toolbar", "pagination", "pager", "search",
}
_NEUTRAL = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "form", "global", "group", "inner", "item", "items", "left", "links", "list", "main",
    "meta", "page", "panel", "post", "posts", "primary", "right", "secondary", "section", "site", "slot", "thread", "top", "unit", "user", "wrap", "wrapper",
}
#: Roles of elements beside the text.
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "menu", "menubar", "toolbar"}
_COMMENT = {"comment", "comments", "reply", "replies"}
MAIN, OPEN, BESIDE = 0, 1, 2


def _named(value: str) -> set[str]:
    """Words of the names in a class or id that say nothing else: each name must consist of them and neutral words."""
    out: set[str] = set()
    for name in value.split():
        parts = {w for w in re.split(r"[-_0-9]+", name) if w}
        if parts <= _BESIDE | _NEUTRAL | {"header"}:
            out |= parts - _NEUTRAL
    return out


def _beside(name: str, rest: str, inside: bool) -> bool:
    """Whether an element, its role or its names say that it is not part of the text. A page's own main element always is."""
    if name in _ASIDE or name == "header" and not inside:
        return True
    if not rest or name in ("body", "html") or name in _MAIN and not inside:
        return False
    found: set[str] = set()
    for m in _ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" and rest[max(0, m.start() - 1) : m.start()].isspace() or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return name not in _MAIN
        if key == "role" and value in _ROLES and not (value == "banner" and inside):
            return name not in _MAIN
        if key in ("class", "id"):
            found |= _named(value)
    return bool(found & (_COMMENT if name in _MAIN else _BESIDE)) or "header" in found and not inside


def page_blocks(page: str) -> list[tuple[str, int]]:
    """(text, MAIN, OPEN or BESIDE) of a page's blocks in order."""
    out: list[tuple[str, int]] = []
    piece: list[str] = []
    around: list[str] = []  # of the block that an inline element beside the text interrupts
    main, skip, depth, at = 0, "", 0, 0

    def close() -> None:
        if piece:
            if text := " ".join(html.unescape("".join(piece)).split()):
                out.append((text, BESIDE if skip else MAIN if main else OPEN))
            piece.clear()

    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        piece.append(page[at : m.start() if m else n])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        opening = not m[1]
        if opening and name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in _BLOCK:
            close()
        elif name in _CELL:
            piece.append(" ")
        if skip:
            if name == skip:
                depth += 1 if opening else -1
            if not depth or opening and name in _MAIN and skip not in _MAIN and not _beside(name, m[3], main > 0) or opening and name == "body" and skip == "head":
                close()
                ended, skip, depth = skip, "", 0
                piece += around
                around.clear()
                if ended == name and not opening:
                    continue
                close()
            else:
                continue
        if opening and name not in _VOID:
            if _beside(name, m[3], main > 0):
                around += piece
                piece.clear()
                skip, depth = name, 1
            elif name in _MAIN:
                main += 1
        elif name in _MAIN and main:
            main -= 1
    close()
    return out


def suffix_order(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first `depth` tokens, and where in that order the common prefix with the one before is shorter than that."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    size = 1
    while True:
        step = min(size, depth - size)
        after = np.zeros(len(rank), np.int64)
        if step < len(rank):
            after[: len(rank) - step] = rank[step:] + 1
        key = rank * (int(after.max(initial=0)) + 1) + after if step else rank
        order = np.argsort(key, kind="stable")
        fresh = np.diff(key[order], prepend=-1) != 0
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(fresh) - 1
        size += step
        if size >= depth:
            return order, fresh


def shared_runs(tokens: np.ndarray, page: np.ndarray, run: int = RUN, pages: int = PAGES) -> np.ndarray:
    """Which tokens lie in a run of `run` tokens that at least `pages` distinct pages have. Tokens of 2**32 and more stand alone."""
    if len(tokens) <= run:
        return np.zeros(len(tokens), bool)
    order, fresh = suffix_order(tokens, run)
    edge = np.append(np.flatnonzero(fresh), len(order))
    group = np.cumsum(fresh) - 1
    both = np.unique(group * (int(page.max()) + 1) + page[order])
    count = np.bincount(both // (int(page.max()) + 1), minlength=len(edge) - 1)
    first = order[(count >= pages)[group]]
    first = first[first + run <= len(tokens)]
    mark = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(mark, first, 1)
    np.add.at(mark, first + run, -1)
    return np.cumsum(mark[:-1]) > 0


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 200):
            yield whole.slice(at, 200)


def _lists(blocks: list[list[str]]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pages' blocks end to end, their bytes and offsets, each page's first block, and the blocks' keys."""
    flat = pa.array([t for b in blocks for t in b], pa.string())
    data, off = text_bytes(flat)
    edge = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype(np.int32)
    return flat, data, off, edge, span_hashes(data, off[:-1], off[1:]).view(np.int64)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's main blocks, or without any its open blocks and their keys."""
    for batch in _few(batches):
        pages = [page_blocks(x) if x else [] for x in batch.column("html").to_pylist()]
        mains = [[t for t, role in p if role == MAIN] for p in pages]
        blocks = [own or [t for t, role in p if role == OPEN] for own, p in zip(mains, pages, strict=True)]
        flat, _, _, edge, keys = _lists(blocks)
        declared = np.repeat([bool(m) for m in mains], [len(b) for b in blocks]).astype(bool)
        made = {"_blocks": pa.ListArray.from_arrays(pa.array(edge), flat), "_keys": pa.ListArray.from_arrays(pa.array(edge), pa.array(keys, mask=declared))}
        yield pa.record_batch({c: batch.column(c) for c in ("_row", "page_id", "url", "_host")} | made)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes (three bytes a word) of each page's blocks outside its main text, and how many words each block has."""
    for batch in _few(batches):
        pages = [page_blocks(x) if x else [] for x in batch.column("html").to_pylist()]
        _, data, off, edge, keys = _lists([[t for t, role in p if role != MAIN] for p in pages])
        starts, ends, upto = words(data, off)
        token = span_hashes(data, starts, ends).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
        size = np.diff(upto)
        made = {
            "_keys": pa.ListArray.from_arrays(pa.array(edge), pa.array(keys)), "_tokens": pa.array([token[upto[a] : upto[b]].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary()),
            "_sizes": pa.array([size[a:b].tolist() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.list_(pa.int32())),
        }
        yield pa.record_batch({c: batch.column(c) for c in ("_host", "_shard")} | made)


_FOUND = "_host string, _key long, _pages long, _size int, _runs array<long>"


def _found(host: str, key: np.ndarray, pages: np.ndarray | None = None, size: np.ndarray | None = None, runs: list | None = None) -> pa.Table:
    n, kinds = len(key), [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
    columns = [pa.nulls(n, t) if x is None else pa.array(x, t) for x, t in zip(([host] * n, key, pages, size, runs), kinds, strict=True)]
    return pa.table(columns, [c.split()[0] for c in _FOUND.split(", ")])


def _counted(host: str, stream: np.ndarray, of: np.ndarray, page: np.ndarray, key: np.ndarray, size: np.ndarray, where: np.ndarray) -> pa.Table:
    """One shard's runs with their pages, and its blocks with theirs and the hashes of their runs in order."""
    hashed = window_hashes(stream.astype(np.uint64), RUN).view(np.int64)
    token = stream < 1 << 32
    first = np.flatnonzero(token[: len(hashed)] & token[RUN - 1 :] & (of[: len(hashed)] == of[RUN - 1 :])) if len(hashed) else np.zeros(0, np.int64)
    name, back = np.unique(hashed[first], return_inverse=True)
    pages = int(where.max()) + 1
    count = np.bincount(np.unique(back.astype(np.int64) * pages + page[first]) // pages, minlength=len(name))
    own, one, back = np.unique(key, return_index=True, return_inverse=True)
    often = np.bincount(np.unique(back.astype(np.int64) * pages + where) // pages, minlength=len(own))
    start = np.cumsum(size + 1) - size - 1
    runs = [hashed[start[i] : start[i] + max(0, size[i] - RUN + 1)].tolist() for i in one]
    return pa.concat_tables([_found(host, name, count), _found(host, own, often, size[one], runs)])


def _boilerplate(table: pa.Table) -> pa.Table:
    """Keys of one host's blocks that its pages share; of a shard of a host the counts."""
    sizes, keys = (table.column(c).to_pylist() for c in ("_sizes", "_keys"))
    tokens, page, block, n_block = [], [], [], 0
    flat_keys, flat_size, flat_page = [], [], []
    for p, raw in enumerate(table.column("_tokens").to_pylist()):
        own = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int64) @ np.array([1, 1 << 8, 1 << 16])
        size = np.array(sizes[p], np.int64)
        cut = np.cumsum(size)
        number = n_block + np.arange(len(size))
        tokens.append(np.insert(own, cut, number + (1 << 32)))
        block.append(np.repeat(number, size + 1))
        page.append(np.full(len(own) + len(size), p))
        n_block += len(size)
        flat_keys += keys[p]
        flat_size.append(size)
        flat_page.append(np.full(len(size), p))
    host = table.column("_host")[0].as_py()
    if not n_block:
        return _found(host, np.zeros(0, np.int64))
    stream, of = np.concatenate(tokens), np.concatenate(block)
    size, key, where = np.concatenate(flat_size), np.array(flat_keys, np.int64), np.concatenate(flat_page)
    if table.column("_shard")[0].as_py() >= 0:
        return _counted(host, stream, of, np.concatenate(page), key, size, where)
    covered = shared_runs(stream, np.concatenate(page))
    gone = (np.bincount(of[covered & (stream < 1 << 32)], minlength=n_block) == size) & (size >= RUN)
    names, back = np.unique(key, return_inverse=True)
    both = np.unique(back.astype(np.int64) * len(sizes) + where)
    gone |= (size < RUN) & (np.bincount(both // len(sizes), minlength=len(names))[back] >= PAGES)
    return _found(host, np.unique(key[gone]))


def _summed(counted: DataFrame) -> DataFrame:
    """(_host, _key): blocks that shared runs cover, or shorter ones on enough pages, by the sums over a host's shards."""
    runs = counted.where("_size is null").groupBy("_host", F.col("_key").alias("_run")).agg(F.sum("_pages").alias("n")).where(F.col("n") >= PAGES).select("_host", "_run")
    blocks = counted.where("_size is not null").groupBy("_host", "_key").agg(F.sum("_pages").alias("n"), F.first("_size").alias("_size"), F.first("_runs").alias("_runs"))
    short = blocks.where((F.col("_size") < RUN) & (F.col("n") >= PAGES)).select("_host", "_key")
    each = blocks.where(F.col("_size") >= RUN).select("_host", "_key", "_size", F.posexplode("_runs").alias("_pos", "_run"))
    hit = each.join(runs, ["_host", "_run"]).groupBy("_host", "_key", "_size").agg(F.array_sort(F.collect_list("_pos")).alias("p"))
    whole = f"p[0] = 0 and element_at(p, -1) = _size - {RUN} and forall(transform(p, (x, i) -> x - if(i = 0, x, p[i - 1])), g -> g <= {RUN})"
    return short.unionByName(hit.where(whole).select("_host", "_key"))


def _rows(pages: DataFrame) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))
    return pages.select("page_id", "url", "html", host.alias("_host"), F.monotonically_increasing_id().alias("_row"))


def boilerplate(pages: DataFrame, shard_pages: int = SHARD_PAGES) -> DataFrame:
    """pages (page_id, url, html) -> (_host, _key): the blocks outside main texts that the host's suffix array removes."""
    rows = _rows(pages)
    big = rows.groupBy("_host").agg(F.ceil(F.count("*") / shard_pages).alias("_n")).where("_n > 1")
    if big.count() <= MOST_BIG_HOSTS:  # at most one in shard_pages of the rows
        big = F.broadcast(big)
    shard = F.coalesce(F.pmod(F.xxhash64("page_id", "url"), F.col("_n").cast("long")), F.lit(-1).cast("long"))
    streams = rows.join(big, "_host", "left").select("_host", shard.alias("_shard"), "html").mapInArrow(_streams, "_host string, _shard long, _keys array<long>, _tokens binary, _sizes array<int>")
    judged = written(streams.groupBy("_host", "_shard").applyInArrow(_boilerplate, _FOUND), "judged")
    found = written(judged.where("_pages is null").select("_host", "_key").unionByName(_summed(judged.where("_pages is not null"))), "boilerplate")
    drop_written(judged)
    return found


def main_text(pages: DataFrame, shard_pages: int = SHARD_PAGES) -> DataFrame:
    """pages (page_id, url, html) -> (page_id, url, text, n_chars), a row for each row."""
    rows = _rows(pages)
    found = boilerplate(pages, shard_pages)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"_row long, page_id {kinds['page_id']}, url string, _host string, _blocks array<string>, _keys array<long>"
    parsed = rows.mapInArrow(_parsed, schema)
    some = F.exists("_keys", lambda x: x.isNotNull())
    sure = parsed.where(~some).select("page_id", "url", F.array_join("_blocks", "\n\n").alias("text"))
    one = parsed.where(some).select("_row", "page_id", "url", "_host", F.posexplode(F.arrays_zip("_blocks", "_keys")).alias("_pos", "_b")).select("_row", "page_id", "url", "_host", "_pos", F.col("_b._blocks").alias("_block"), F.col("_b._keys").alias("_key"))
    one = one.join(found.withColumn("_gone", F.lit(True)), ["_host", "_key"], "left")
    kept = F.collect_list(F.when(F.col("_gone").isNull(), F.struct("_pos", "_block")))
    unsure = one.groupBy("_row", "page_id", "url").agg(F.array_sort(kept).alias("_k")).select("page_id", "url", F.array_join(F.transform("_k", lambda x: x["_block"]), "\n\n").alias("text"))
    out = sure.unionByName(unsure)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
