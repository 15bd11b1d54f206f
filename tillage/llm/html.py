"""HTML extraction: main-content elements and nearest-URL page differencing.

A page is cut into text lines, one per block. Every line has a role: inside the
marked article (``article``, ``main``, role ``main``, itemprop
``articleBody``), cut (in elements that hold no article: menus, page headers and
footers, sidebars, form controls, notices, adverts, reader comments, told by
tag, role and class as whole names) or open. An article marked within such an
element, or so named itself, is cut only where the page marks another one.

Boilerplate is told by differencing: pages are ordered by URL path within their
host, every page is aligned with the page before and after it by the longest
common subsequence of all their lines, cut ones too, and the lines they share
outside a marked article are deleted. The text is what is left of the lines
that can be text: those of the marked article, whole, or, where a page marks
none, its open lines. Pages in a row whose lines that can be text are the same
are copies that tell nothing, so the nearest different pages are taken.

The order is a distributed sort by (host, path, page), so a host with a third
of all pages is spread over many tasks; pages in a row with the same lines that can be text
are one run, and neighbours are found by the runs' rank. Only line fingerprints
take part in the alignment. Texts are cut from the pages again at the end and
meet the positions of their shared lines by a fingerprint of the row.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillage.llm.tables import written
from tillage.llm.words import slices, word_hashes

# Fixed values of HTML: elements whose content isn't text, void elements, block elements.
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "math", "iframe", "canvas", "object", "title", "video", "audio")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NO_ARTICLE = frozenset("aside button dialog footer header head input label menu nav select option fieldset".split())
NO_ARTICLE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog toolbar".split())
NO_ARTICLE_NAMES = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright dialog disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup "
    "promo promotion related respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(" + "|".join(RAW) + r")\b[^>]*+>.*?(?:</\1\s*+>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>", re.S | re.I)
# What may stand before such a name in a class or id ("main-menu"); other words before it say something else ("with-sidebar").
NAME_STARTS = frozenset(
    "main site page top bottom left right side primary secondary global mobile desktop sub user reader post article entry blog google "
    "social cookie nav navigation menu footer header sidebar comment comments".split())
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_PART = re.compile(r"[-_]+")
_SPACE = re.compile(r"\s+")
# Roles of lines.
CUT, OPEN, ARTICLE = 0, 1, 2


def _boilerplate(name: str) -> bool:
    """Whether a whole class name or id names an element without an article."""
    parts = _PART.split(re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())
    return parts[-1] in NO_ARTICLE_NAMES and NAME_STARTS.issuperset(parts[:-1])


def _role(tag: str, rest: str) -> str:
    """'skip', 'article', 'doubtful' (an article named as none) or '' for an opening tag."""
    said: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        said.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    role = said.get("role", "").lower()
    if tag == "main" or role == "main" or said.get("itemprop", "").lower() == "articlebody":
        return "article"
    if tag in ("html", "body"):
        return ""
    skip = tag in NO_ARTICLE or role in NO_ARTICLE_ROLES or "hidden" in said or said.get("aria-hidden", "").lower() == "true"
    skip = skip or any(_boilerplate(x) for x in (*said.get("class", "").split(), *said.get("id", "").split()))
    if tag == "article":
        return "doubtful" if skip else "article"
    return "skip" if skip else ""


def page_lines(page: str) -> list[tuple[str, int]]:
    """All text blocks of the page in order, with their roles; a block's text in cut inline elements is a line of its own."""
    lines: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    cut: list[str] = []
    stack: list[tuple[str, str]] = []  # open elements that matter: (tag, role)
    roles: list[str] = []  # those of them that have one

    def taken() -> list[str]:
        return cut if roles and roles[-1] == "skip" else parts

    def flush() -> None:
        for kept in (parts, cut):
            if kept:
                text = _SPACE.sub(" ", entities.unescape("".join(kept))).strip()
                if text:
                    inside = kept is parts and ("article" in roles or "doubtful" in roles)
                    lines.append((text, CUT if kept is cut else ARTICLE if inside else OPEN, inside and ("skip" in roles or "doubtful" in roles)))
                kept.clear()

    def close(at: int) -> None:
        for _, role in stack[at:]:
            if role:
                roles.pop()
        del stack[at:]

    end = 0
    for m in _TOKEN.finditer(page):
        if m.start() > end:
            taken().append(page[end:m.start()])
        end = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        shut, rest = m[2] or m[5], m[4] or m[7] or ""
        if tag in BLOCK or tag in ("br", "option", "button"):
            if tag == "br":
                taken().append(" ")
                continue
            flush()
        if shut:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
        elif tag not in VOID and not rest.endswith("/"):
            # Blocks that may stay open end where the next one like them begins.
            if tag in BLOCK and stack and stack[-1][0] in ("p", "li", "dt", "dd", "option") and (stack[-1][0] == "p" or stack[-1][0] == tag):
                close(len(stack) - 1)
            role = _role(tag, rest)
            if role or (tag in BLOCK):
                stack.append((tag, role))
                if role:
                    roles.append(role)
    taken().append(page[end:])
    flush()
    sure = any(role == ARTICLE and not doubtful for _, role, doubtful in lines)
    return [(text, CUT if sure and doubtful else role) for text, role, doubtful in lines]


def text_lines(page: str) -> list[tuple[str, bool]]:
    """The lines that aren't cut: (text, inside a marked article)."""
    return [(text, role == ARTICLE) for text, role in page_lines(page) if role != CUT]


def _table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i, x in enumerate(a):
        np.maximum.accumulate(np.maximum(out[i, 1:], out[i, :-1] + (b == x)), out=out[i + 1, 1:])
    return out


def _last_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def common_lines(a: np.ndarray, b: np.ndarray, cells: int = 1 << 22) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b`` (split in halves where the table would be large)."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    if head:
        return [*range(head), *(head + i for i in common_lines(a[head:], b[head:], cells))]
    both = np.isin(a, b)
    if not both.all():
        at = np.flatnonzero(both)
        return [int(at[i]) for i in common_lines(a[at], b[np.isin(b, a)], cells)] if len(at) else []
    if len(a) <= 1 or len(b) <= 1:
        return [0] if len(a) and len(b) else []
    if len(a) * len(b) > cells:
        mid = len(a) // 2
        cut = int(np.argmax(_last_row(a[:mid], b) + _last_row(a[mid:][::-1], b[::-1])[::-1]))
        return common_lines(a[:mid], b[:cut], cells) + [mid + i for i in common_lines(a[mid:], b[cut:], cells)]
    t, i, j, out = _table(a, b), len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1] and t[i, j] == t[i - 1, j - 1] + 1:
            i, j = i - 1, j - 1
            out.append(i)
        elif t[i - 1, j] >= t[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _mark_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Line fingerprints and roles of each page."""
    for b in slices(batches, "html"):
        lines = [page_lines(page or "") for page in b.column("html").to_pylist()]
        texts = pa.array([[t for t, _ in x] for x in lines], pa.list_(pa.string()))
        marks = pa.ListArray.from_arrays(texts.offsets, pa.array(word_hashes(texts.flatten()).view(np.int64)))
        roles = pa.array([[role for _, role in x] for x in lines], pa.list_(pa.int8()))
        yield pa.record_batch([*(b.column(c) for c in ("host", "path", "id", "key")), marks, roles], names=["host", "path", "id", "key", "marks", "roles"])


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each page that can be its text: those of its article where it marks one."""
    for b in slices(batches, "html"):
        out = []
        for page in b.column("html").to_pylist():
            lines = text_lines(page or "")
            marked = any(main for _, main in lines)
            out.append([t for t, main in lines if main or not marked])
        yield pa.record_batch([b.column("row"), b.column("key"), pa.array(out, pa.list_(pa.string()))], names=["row", "key", "lines"])


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the runs of a sorted partition; only the first page of a run keeps its fingerprints."""
    last, n = None, -1
    for b in batches:
        runs, first = [], []
        for kind in zip(b.column("host").to_pylist(), b.column("kind").to_pylist()):
            first.append(kind != last)
            n += kind != last
            runs.append(n)
            last = kind
        first = pa.array(first, pa.bool_())
        kept = [pa.array([x if f else None for x, f in zip(b.column(c).to_pylist(), first.to_pylist())], b.column(c).type) for c in ("marks", "roles")]
        yield pa.record_batch([b.column("host"), b.column("kind"), b.column("key"), b.column("part"), pa.array(runs, pa.int64()), first, *kept],
                              names=["host", "kind", "key", "part", "run", "first", "marks", "roles"])


def shared_lines(own: np.ndarray, roles: np.ndarray, others: list[np.ndarray]) -> list[int]:
    """Positions, among the lines that can be text, of those that a neighbour shares outside a marked article."""
    common: set[int] = set()
    for other in others:
        if len(own) and len(other) and not np.array_equal(own, other):
            common.update(common_lines(own, other))
    can = np.flatnonzero(roles == max(OPEN, roles.max(initial=OPEN)))
    return [i for i, at in enumerate(can.tolist()) if at in common and roles[at] != ARTICLE]


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for own, roles, *others in zip(*(b.column(c).to_pylist() for c in ("marks", "roles", "before", "after"))):
            out.append(shared_lines(np.array(own, np.int64), np.array(roles, np.int8), [np.array(o or [], np.int64) for o in others]))
        yield pa.record_batch([b.column("rank"), pa.array(out, pa.list_(pa.int32()))], names=["rank", "shared"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` but the html, and ``text`` (lines joined by LF, empty if none) and ``n_chars`` (code points).

    Null and empty html give the empty text. Null URLs are one host without a
    path. Pages with the same URL are ordered by id, repeated rows stay rows.
    A page of any length is parsed whole in one task. Input columns of these names are replaced. An empty table gives none.
    """
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in ("text", "n_chars", html_col)]
    html, url = F.col(f"`{html_col}`").cast("string"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    # Rows of the same key are the same page: they stand next to each other and share the same lines with their neighbours.
    packed = pages.select(html.alias("html"), url.alias("url"), F.col(f"`{id_col}`").alias("id"), F.struct(*keep).alias("row")).withColumn(
        "key", F.concat_ws("/", F.xxhash64("html", "url", "id"), F.xxhash64(F.lit(1), "html", "url", "id")))
    host = F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^(?:(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    placed = packed.select("html", host.alias("host"), path.alias("path"), "id", "key")
    order = ["host", "path", "id", "key"]
    schema = T.StructType([*placed.schema.fields[1:]]).add("marks", T.ArrayType(T.LongType())).add("roles", T.ArrayType(T.ByteType()))
    # Written, so that the sort's sample doesn't parse the pages again.
    told = written(placed.mapInArrow(_mark_rows, schema).where(F.size("marks") > 0))
    can = F.expr("filter(marks, (x, i) -> roles[i] = greatest(array_max(roles), 1))")
    sorted_ = (told.repartitionByRange(*order).sortWithinPartitions(*order)
               .select("host", "key", "marks", "roles", F.xxhash64(can, F.array_max("roles")).alias("kind"), F.spark_partition_id().alias("part")))
    runs = "host string, kind long, key string, part int, run long, first boolean, marks array<long>, roles array<tinyint>"
    ranked = written(sorted_.mapInArrow(_run_rows, runs))
    # Ranks run on over the partitions (one row each): a first run that goes on from the partition before has its rank.
    edge = F.struct("host", "kind")
    ends = ranked.where("first").groupBy("part").agg(F.max("run").alias("last"), F.min_by(edge, "run").alias("from"), F.max_by(edge, "run").alias("to"))
    goes_on = F.coalesce(F.col("from") == F.lag("to").over(Window.orderBy("part")), F.lit(False)).cast("long")
    ends = ends.select("part", "last", goes_on.alias("goes_on"))
    ahead = ends.select("part", "goes_on", (F.sum(F.col("last") + 1 - F.col("goes_on")).over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("last") - 1).alias("ahead"))
    rank = ranked.join(ahead, "part").withColumn("rank", F.col("run") + F.col("ahead"))
    own = rank.where(F.col("first") & ~((F.col("goes_on") == 1) & (F.col("run") == 0))).select("host", "rank", "marks", "roles")

    def neighbour(step: int, name: str) -> DataFrame:
        return own.select("host", (F.col("rank") + step).alias("rank"), F.col("marks").alias(name))

    pairs = own.join(neighbour(1, "before"), ["host", "rank"], "left").join(neighbour(-1, "after"), ["host", "rank"], "left")
    shared = pairs.select("rank", "marks", "roles", "before", "after").mapInArrow(_shared_rows, "rank long, shared array<int>")
    # Written, so that its size is known: where it is small, the texts aren't shuffled.
    shared = written(shared.where(F.size("shared") > 0))
    by_key = written(rank.select("key", "rank").join(shared, "rank").select("key", "shared").dropDuplicates(["key"]))
    lines = packed.select("html", "row", "key").mapInArrow(
        _line_rows, T.StructType([*packed.schema.fields[3:]]).add("lines", T.ArrayType(T.StringType())))
    kept = F.expr("array_join(filter(lines, (x, i) -> not array_contains(coalesce(shared, array()), i)), '\n')")
    return lines.join(by_key, "key", "left").select("row.*", kept.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
