"""Main text of web pages: their markup, and a suffix array over each host's pages.

Pages are parsed into blocks of text in page order. Blocks in menus, headers, footers, sidebars, notices, adverts,
forms, comments and the like are boilerplate by their markup, and blocks of an article or main element are content.
The token streams of a host's pages are concatenated, and a suffix array (sorted to a bounded depth by prefix
doubling) finds token runs that stand on several distinct pages. Of blocks that the markup leaves open, those mostly
covered by runs of two pages or more are dropped and those with unique runs are kept. Blocks of an article are dropped
only if they are covered by runs that stand on half of at least COMMON_PAGES pages: fewer would also hit copies of
articles, whose text must stay.

A host's pages are split by a hash into groups of about GROUP_PAGES, so a host of any size is many bounded tasks. All
rows of a page are in one group, so a run's pages on the host are the sum of those in its groups: where a host has
several groups, runs and short blocks go by 64-bit digests, and each group gets the sums of those that other groups have
too. On a host whose pages all have articles only runs on half of the pages matter; a sketch of counts per bucket of
digests, never too low, tells which can't be such, and those needn't be sent. What is dropped is the same for any
GROUP_PAGES.

Defined results: null or empty html gives empty text; repeated rows each keep their row and don't count as distinct
pages; a null url is a host of its own; a null page_id stays null; an empty table gives no rows; extra columns of the
input are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import small_side, stored
from tessella.shipping import map_arrow

GROUP_PAGES = 256
#: Tokens of a run that counts as repeated, and the share of a block that such runs must cover to drop it.
RUN, COVER = 8, 0.6
#: Buckets of a host's sketch. It only divides the work.
SKETCH = 1 << 13
#: Pages that a host needs before anything in an article counts as common to its host.
COMMON_PAGES = 20
_MAIN = frozenset("article article-body articlebody article-content post-content post-body entry-content main-content story-body".split())

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
_DROPPED = frozenset("script style noscript template textarea title iframe noembed noframes xmp nav header footer aside form button select option input svg math canvas audio video object menu dialog head label fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist note".split())
_BOILERPLATE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adslot|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|pager|pagination|comments?|commentlist|respond|disqus|replies|footer|masthead|header|site-?header|related|recommend\w*|share|sharing|social|subscribe|newsletter|signup|login|toolbar|widget|skip-?link|disclaimer|copyright|tags?|byline-links)(?:$|[\s_-]|\d)", re.I)
#: A p ends where one of these begins; an li, td and the like where their own kind does.
_ENDS_P = _BLOCK - {"td", "th", "tr", "option", "caption", "body", "html", "head", "title", "tbody", "thead", "tfoot"}
_ENDS_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTENT, OPEN = 1, 0


def _boilerplate(name: str, attributes: str) -> bool:
    if name in _DROPPED:
        return True
    if name in ("html", "body", "article", "main") or not attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id") and _BOILERPLATE.search(value) or key == "role" and value.lower() in _ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def _is_main(attributes: str) -> bool:
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "role" and value in ("main", "article") or key == "itemprop" and value == "articlebody" or key in ("class", "id") and _MAIN.intersection(value.split()):
            return True
    return False


def blocks(page: str) -> list[tuple[str, int]]:
    """Blocks in page order: text with references decoded and white space made single, and CONTENT or OPEN."""
    out: list[tuple[str, int]] = []
    buffer: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, within boilerplate, within article or main
    bad = inside = False

    def flush() -> None:
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                out.append((text, CONTENT if inside else OPEN))

    def close(upto: int) -> None:
        nonlocal bad, inside
        flush()
        del stack[upto:]
        bad, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            if not bad:
                buffer.append(page[at:])
            break
        if m.start() > at and not bad:
            buffer.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in _BLOCK or name in _DROPPED or any(s[0] == name for s in stack[-8:]):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        if name in _BLOCK or any(s[0] in _BLOCK or s[1] for s in stack[k:]):
                            close(k)
                        else:
                            del stack[k:]
                        break
                else:
                    if name in _BLOCK:
                        flush()
            continue
        if name == "br":
            if not bad:
                buffer.append(" ")
            continue
        if name in _RAW:
            stop = re.compile(rf"</{name}\b[^>]*(?:>|$)", re.I).search(page, at)
            at = stop.end() if stop else end
            if name in _BLOCK:
                flush()
            continue
        if name in _VOID:
            if name == "hr":
                flush()
            continue
        if name in _ENDS_P and name != "p" or name == "p":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in _BLOCK:
                    break
        for own in _ENDS_OWN.get(name, ()):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == own:
                    close(k)
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "select", "menu"):
                    break
        if name in _BLOCK:
            flush()
        if not m[3].endswith("/") or name in _BLOCK:
            b = bad or _boilerplate(name, m[3])
            if b and not bad:
                flush()
            bad, inside = b, inside or name in ("article", "main") or bool(m[3]) and _is_main(m[3])
            stack.append((name, bad, inside))
    flush()
    if any(kind == CONTENT for _, kind in out):
        return [x for x in out if x[1] == CONTENT]
    return out


def run_pages(tokens: np.ndarray, page: np.ndarray, run: int = RUN) -> np.ndarray:
    """For each token the number of distinct pages that its most common run of ``run`` tokens stands on; 0 if no run
    covers it. tokens: numbers from 1, with 0 between pages; page: the page of each."""
    return _covered(_run_starts(tokens, page, run), run)


def _covered(at_start: np.ndarray, run: int) -> np.ndarray:
    """For each token the largest number of the runs that cover it."""
    n, most = len(at_start), at_start.copy()
    for k in range(1, min(run, n)):
        np.maximum(most[k:], at_start[: n - k], out=most[k:])
    return most


def _run_starts(tokens: np.ndarray, page: np.ndarray, run: int = RUN) -> np.ndarray:
    """For each token the number of distinct pages with the run that starts there; 0 if none does. Prefix doubling
    ranks all suffixes by their first ``run`` tokens."""
    n = len(tokens)
    if n < run:
        return np.zeros(n, np.int64)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    depth = 1
    while depth < run:
        step = min(depth, run - depth)
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        depth += step
    order = np.lexsort((page, rank))  # the suffix array, to this depth
    r, p = rank[order], page[order]
    first = np.r_[True, r[1:] != r[:-1]]
    starts = np.flatnonzero(first)
    kinds = np.add.reduceat((first | np.r_[True, p[1:] != p[:-1]]).astype(np.int64), starts)
    at_start = np.zeros(n, np.int64)
    at_start[order] = np.repeat(kinds, np.diff(np.r_[starts, n]))
    zero = np.r_[0, np.cumsum(tokens == 0)]
    last = n - run + 1
    at_start[last:] = 0
    at_start[:last][zero[run : run + last] != zero[:last]] = 0  # runs don't reach over a page's end
    return at_start


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _run_keys(digests: np.ndarray, starts: np.ndarray, run: int = RUN) -> np.ndarray:
    """Digests of the runs that start at ``starts``, from those of all tokens."""
    key = np.zeros(len(starts), np.uint64)
    for k in range(run):
        key = (key ^ digests[starts + k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


#: The key under which a host's number of distinct pages stands.
_PAGES = _digest("pages")


class _Digests(dict):
    """Word -> digest; begun anew when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = value = _digest(word)
        return value


_DIGESTS = _Digests()


def _page_keys(texts: list[str]) -> np.ndarray:
    """The digests of a page's runs, each once."""
    digests = np.array([_DIGESTS[w] for t in texts for w in t.split()], np.int64).view(np.uint64)
    return np.unique(_run_keys(digests, np.arange(max(0, len(digests) - RUN + 1))))


def keep_unique(pages: list[list[str]], names: list[object], content: list[bool], sums: dict[int, int] | None = None) -> list[list[str]]:
    """Blocks of a host's pages without those that repeated runs cover. names: what makes a page distinct; content:
    whether the markup says that a page's blocks are its article; sums: by key, the pages on the whole host of what
    other groups of it have too, if it has any."""
    sums = sums or {}
    vocabulary: dict[str, int] = {}
    tokens: list[int] = []
    owner: list[int] = []
    spans: list[list[tuple[int, int]]] = []
    number: dict[object, int] = {}
    seen: dict[str, set[int]] = {}
    for blocks_of, name, sure in zip(pages, names, content, strict=True):
        own = number.setdefault(name, len(number))
        spans.append([])
        for b in blocks_of:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in b.split()]
            spans[-1].append((len(tokens), len(tokens) + len(ids)))
            tokens += ids
            owner += [own] * len(ids)
            if not sure and len(ids) < RUN:
                seen.setdefault(b, set()).add(own)
        tokens.append(0)
        owner.append(own)
    at_start = _run_starts(np.array(tokens), np.array(owner))
    if len(sums) > 1:
        starts = np.flatnonzero(at_start)
        digests = np.array([0, *map(_digest, vocabulary)], np.int64).view(np.uint64)[np.array(tokens)]
        whole = [sums.get(k, 0) for k in _run_keys(digests, starts).tolist()]
        at_start[starts] = np.maximum(at_start[starts], np.array(whole, np.int64))
    on = _covered(at_start, RUN)
    n_pages = sums.get(_PAGES, len(number))
    half = max(2, n_pages / 2)
    repeated, common = (np.r_[0, np.cumsum(on >= least)] for least in (2, half))
    out = []
    for blocks_of, places, sure in zip(pages, spans, content, strict=True):
        kept = []
        for b, (x, y) in zip(blocks_of, places, strict=True):
            if sure:
                drop = n_pages >= COMMON_PAGES and y - x >= RUN and common[y] - common[x] >= COVER * (y - x)
            elif y - x >= RUN:
                drop = repeated[y] - repeated[x] >= COVER * (y - x)
            else:
                drop = max(len(seen[b]), sums.get(_digest("block " + b), 0) if len(sums) > 1 else 0) > max(1, 0.5 * n_pages)
            if not drop:
                kept.append(b)
        out.append(kept)
    return out


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sure = [], []
            for value in batch.column(4):
                found = blocks(value.as_py() or "")
                texts.append([t for t, _ in found])
                sure.append(bool(found) and found[0][1] == CONTENT)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(texts, pa.list_(pa.string())), pa.array(sure)], ["page_id", "url", "host", "split", "blocks", "sure"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    host = F.coalesce(F.lower(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    sizes = stored(rows.groupBy(host.alias("host")).agg(F.count("*").alias("pages"), F.countDistinct(F.struct("page_id", "url")).alias("distinct_pages")), "hosts")  # reads ids and urls alone
    split = F.pmod(F.xxhash64("page_id", "url"), F.ceil(F.col("pages") / GROUP_PAGES).cast("long"))
    placed = rows.withColumn("host", host).join(small_side(sizes), "host").select("page_id", "url", "host", split.alias("split"), "html", "pages", "distinct_pages")
    parse_of = lambda rows: map_arrow(rows.drop("pages", "distinct_pages"), parse, f"page_id {kind}, url string, host string, split long, blocks array<string>, sure boolean")

    def columns(rows: pa.Table) -> tuple[list, list, list]:
        names = list(zip(rows["page_id"].to_pylist(), rows["url"].to_pylist(), strict=True))
        return rows["blocks"].to_pylist(), names, rows["sure"].to_pylist()

    def result(rows: pa.Table, kept: list[list[str]]) -> pa.Table:
        text = pa.array(["\n".join(b) for b in kept], pa.string())
        return pa.table([rows["page_id"], rows["url"], text], names=["page_id", "url", "text"])

    def of_host(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        return result(rows, keep_unique(*columns(rows)))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}  # by host: whether it has an open page, distinct pages, rows by bucket

        def flush() -> pa.RecordBatch:
            data = [(h, o, n, c.tobytes()) for h, (o, n, c) in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([d[k] for d in data], t) for k, t in enumerate((pa.string(), pa.bool_(), pa.int64(), pa.binary()))], ["host", "open", "distinct_pages", "counts"])

        for batch in batches:
            for host, n, value in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found = blocks(value or "")
                own = held.setdefault(host, [False, n, np.zeros(SKETCH, np.int64)])
                own[0] = own[0] or bool(found) and found[0][1] == OPEN
                own[2] += np.bincount(_page_keys([t for t, _ in found]) % SKETCH, minlength=SKETCH)
                if len(held) >= 256:
                    yield flush()
        yield flush()

    def summed(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        total = sum(np.frombuffer(c, np.int64) for c in rows["counts"].to_pylist())
        has_open = any(rows["open"].to_pylist())
        hot = [] if has_open else np.flatnonzero(total >= max(2, rows["distinct_pages"][0].as_py() / 2)).tolist()
        return pa.table([pa.array([rows["host"][0].as_py()]), pa.array([has_open]), pa.array([hot], pa.list_(pa.int64()))], names=["host", "open", "hot"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, splits, pages_of, found_keys = [], [], [], []
            for host, split_of, name, value, has_open, hot in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                found = blocks(value or "")
                own = _page_keys([t for t, _ in found])
                if has_open:
                    short = {_digest("block " + t) for t, kind_of in found if found[0][1] == OPEN and len(t.split()) < RUN}
                    own = np.r_[own, np.array([*short], np.int64)]
                else:
                    own = own[np.isin(own % SKETCH, hot)]
                hosts += [host] * len(own)
                splits += [split_of] * len(own)
                pages_of += [name] * len(own)
                found_keys += own.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(x, pa.int64()) for x in (splits, pages_of, found_keys))], ["host", "split", "name", "key"])

    def of_part(rows: pa.Table, whole: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        if not rows.num_rows:  # no page has this number
            return result(rows, [])
        sums = dict(zip(whole["key"].to_pylist(), whole["n"].to_pylist(), strict=True))
        return result(rows, keep_unique(*columns(rows), sums))

    schema = f"page_id {kind}, url string, text string"
    out = lambda found: found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
    large = F.col("pages") > GROUP_PAGES
    if sizes.where(large).isEmpty():
        return out(parse_of(placed).groupBy("host", "split").applyInArrow(of_host, schema))
    several = placed.where(large)
    sketches = map_arrow(several.select("host", "distinct_pages", "html"), sketch, "host string, open boolean, distinct_pages long, counts binary")
    hosts = stored(sketches.groupBy("host").applyInArrow(summed, "host string, open boolean, hot array<long>"), "sketches")
    sums = sizes.where(large).select("host", F.explode(F.sequence(F.lit(0), F.ceil(F.col("pages") / GROUP_PAGES).cast("long") - 1)).alias("split"), F.lit(_PAGES).alias("key"), F.col("distinct_pages").alias("n"))
    sought = hosts.where("open or size(hot) > 0")
    if not sought.isEmpty():
        page = several.join(small_side(sought), "host").select("host", "split", F.xxhash64(F.to_json(F.struct("page_id", "url"))).alias("name"), "html", "open", "hot")
        found = map_arrow(page, keys, "host string, split long, name long, key long").distinct()
        counted = found.groupBy("host", "split", "key").agg(F.count("*").alias("n")).groupBy("host", "key").agg(F.sum("n").alias("n"), F.collect_list("split").alias("splits"))
        sums = sums.unionByName(counted.where(F.size("splits") > 1).select("host", F.explode("splits").alias("split"), "key", "n"))
    sums = stored(sums, "sums")
    whole = parse_of(several).groupBy("host", "split").cogroup(sums.groupBy("host", "split")).applyInArrow(of_part, schema)
    return out(parse_of(placed.where(~large)).groupBy("host", "split").applyInArrow(of_host, schema).unionByName(whole))
