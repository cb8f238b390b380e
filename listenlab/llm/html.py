"""Main text of web pages by wrapper induction.

Pages of a host with the same kinds of elements are a layout; one of them, the same on every run,
stands for it. Every page's tree is aligned with its layout's by simple tree matching, where nodes of
the same text match better, so each text of a page gets a slot: the place of its element in the tree
that stands for the layout. Over all distinct pages of the host it is counted how many have a slot and
how many say the same there: what most of them are bound to say, judged from those that there are, is
template; slots that vary, and those too few pages speak of, are content. Names of elements and classes tell furniture that varies too, such as adverts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_arrow_batches, written

#: Bytes of trees that stand for layouts, and of wrappers, up to which they are broadcast; beyond, an ordinary join.
BROADCAST_BYTES = 16 << 20
#: Pairs of siblings up to which all are tried; beyond, equal ones are anchors and those between them match in order.
PAIRS = 1024
#: Deviates of the bound below which the share of a host's pages that say the same can hardly lie; of four pages all must agree, of ten nine.
SURE = 1.96
#: What tells names that change from page to page.
VOLATILE = re.compile(r"\d")

#: Elements by kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is never shown as text; furniture, and that of it that can stand around a whole page; what holds the article; text inside it.
SILENT = set("script style noscript template iframe select textarea head title svg object button".split())
FURNITURE = set("nav footer aside form header dialog menu".split())
AROUND = set("form aside header dialog".split())
ARTICLE = set("article main".split())
PROSE = set("p li h1 h2 h3 h4 h5 h6 blockquote pre td th dd dt b i em strong span code a figcaption".split())
#: Words in class or id that tell furniture, and words beside them that say that there is none.
NAMES = set(
    "ad ads advert advertisement advertising banner sponsor sponsored promo promotion sidebar side cookie cookies consent gdpr notice notices "
    "alert comment comments disqus reply replies respond menu nav navbar navigation breadcrumb breadcrumbs share sharing social related "
    "recommended newsletter subscribe signup login popup modal overlay pagination pager footer masthead topbar toolbar widget".split()
)
WITHOUT = set("has have no not with without free less is".split())
#: An element that the start of another closes, up to the barriers.
CLOSES = {
    **{t: {"p"} for t in BLOCK - {"html", "body", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}},
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"},
    "th": {"td", "th", "p"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "thead": {"tbody", "tr"}, "tfoot": {"tbody", "tr", "td", "th"},
}
BARRIERS = set("table ul ol dl div section article main aside body html blockquote form nav header footer td th".split())


class Node:
    __slots__ = ("kids", "names", "parent", "tag")

    def __init__(self, tag: str, names: str, parent: Node | None):
        self.tag, self.names, self.parent, self.kids = tag, names, parent, []

    def named(self) -> bool:
        """Whether a name of class or id tells furniture."""
        if not self.names or self.tag in ("html", "body"):
            return False
        words = [set(re.split(r"[^a-z]+", n)) for n in self.names.lower().split()]
        return any(not NAMES.isdisjoint(w) and WITHOUT.isdisjoint(w) for w in words)


class _Builder(HTMLParser):
    """Trees of pages however broken: ends that are missing are put where the next start or end needs them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", "", None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if closes := CLOSES.get(tag):
            n = self.at
            while n.parent is not None:
                if n.tag in closes:
                    self.at = n.parent
                    break
                if n.tag in BARRIERS:
                    break
                n = n.parent
        names = " ".join(v for k, v in attrs if k in ("id", "class", "role") and v)
        node = Node(tag, names, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK and self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent is not None:
            if n.tag == tag:
                self.at = n.parent
                return
            if n.tag in BARRIERS and tag not in BARRIERS:
                return
            n = n.parent

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)


def parse(page: str) -> Node:
    b = _Builder()
    b.feed(page)
    b.close()
    return b.root


class Outline:
    """A page's elements in order of the page, silent ones left out; what runs of text they hold, and where blocks break."""

    def __init__(self, root: Node):
        self.tags: list[str] = []
        self.kids: list[list[int]] = []
        self.path: list[int] = []
        # of each run of text: its text, the element it stands in, whether a block begins before it, whether it is in a link, in an article
        self.runs: list[tuple[str, int, bool, bool, bool]] = []
        # furniture, outermost first: the first run, the one behind the last, whether it can stand around a page
        self.furniture: list[tuple[int, int, bool]] = []
        own: list[list[str]] = []
        open_: list = [(root, -1, 0, False, False)]
        broken = True
        while open_:
            x, parent, path, link, article = open_.pop()
            if x is None:  # an element ends: whether it is a block, and its place among furniture
                broken |= link
                if parent >= 0:
                    self.furniture[parent] = (self.furniture[parent][0], len(self.runs), self.furniture[parent][2])
                continue
            if type(x) is str or x.tag == "br":
                text = x if type(x) is str else " "
                self.runs.append((text, parent, broken, link, article))
                own[parent].append(text)
                broken = False
                continue
            if x.tag in SILENT:
                continue
            at = len(self.tags)
            path = _step(path, f"{x.tag} {' '.join(n for n in x.names.split() if not VOLATILE.search(n))}" if x.names else x.tag)
            self.tags.append(x.tag)
            self.kids.append([])
            self.path.append(path)
            own.append([])
            if parent >= 0:
                self.kids[parent].append(at)
            tagged = x.tag in FURNITURE and not (x.tag == "header" and article)
            spot = -1
            if tagged or (x.named() and not (article and x.tag in PROSE)):
                spot = len(self.furniture)
                self.furniture.append((len(self.runs), -1, not article and (x.tag in AROUND or not tagged)))
            broken |= x.tag in BLOCK
            open_.append((None, spot, 0, x.tag in BLOCK, False))
            inside = article or x.tag in ARTICLE
            open_ += [(k, at, path, link or x.tag == "a", inside) for k in reversed(x.kids)]
        self.own = [" ".join(" ".join(o).split()) for o in own]
        # what is below each element, as one number; what it scores against its equal
        self.whole, self.weight = [0] * len(self.tags), [1 + bool(o) for o in self.own]
        for i in range(len(self.tags) - 1, -1, -1):
            self.whole[i] = hash((self.tags[i], self.own[i], *[self.whole[k] for k in self.kids[i]]))
            self.weight[i] += sum(self.weight[k] for k in self.kids[i])

    def places(self) -> list[int]:
        """Of each element its path and its number among those of the path, as one number."""
        seen: dict[int, int] = {}
        out = []
        for p in self.path:
            seen[p] = k = seen.get(p, -1) + 1
            out.append(_key(p, str(k)))
        return out


def outline(page: str) -> Outline:
    return Outline(parse(page))


@lru_cache(20_000)
def _step(path: int, step: str) -> int:
    return _key(path, step)


def _key(path: int, text: str) -> int:
    return int.from_bytes(blake2b(f"{path} {text}".encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _ends(a: Outline, b: Outline, x: list[int], y: list[int]) -> tuple[int, int]:
    """How many siblings are equal from the start, and from the end."""
    most = min(len(x), len(y))
    head = 0
    while head < most and a.whole[x[head]] == b.whole[y[head]]:
        head += 1
    tail = 0
    while tail < most - head and a.whole[x[-1 - tail]] == b.whole[y[-1 - tail]]:
        tail += 1
    return head, tail


def _anchored(a: Outline, b: Outline, x: list[int], y: list[int]) -> list[tuple[int, int]]:
    """Pairs for long rows of siblings, in order and in near-linear time.

    Elements that stand once in each row and are equal anchor the rows, as many as keep their order;
    between anchors those of one kind match one after the other.
    """
    once = [{}, {}]
    for o, row, at in ((a, x, once[0]), (b, y, once[1])):
        for i, k in enumerate(row):
            at[o.whole[k]] = -1 if o.whole[k] in at else i
    both = [(i, once[1][w]) for w, i in once[0].items() if i >= 0 and once[1].get(w, -1) >= 0]
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(both):  # longest run of anchors in order
        k = bisect_left(tops, j)
        back.append(ends[k - 1] if k else -1)
        if k == len(tops):
            tops.append(j)
            ends.append(n)
        else:
            tops[k], ends[k] = j, n
    chain = []
    n = ends[-1] if ends else -1
    while n >= 0:
        chain.append(both[n])
        n = back[n]
    out, i, j = [], 0, 0
    for p, q in [*reversed(chain), (len(x), len(y))]:
        while i < p and j < q:
            if a.tags[x[i]] == b.tags[y[j]]:
                out.append((x[i], y[j]))
                i, j = i + 1, j + 1
            elif p - i > q - j:
                i += 1
            else:
                j += 1
        if p < len(x):
            out.append((x[p], y[q]))
        i, j = p + 1, q + 1
    return out


def _paired(a: Outline, b: Outline, x: list[int], y: list[int], known: dict) -> tuple[int, list[tuple[int, int]]]:
    """The best matching of two rows of siblings in order, from the scores of their pairs."""
    if not x or not y:
        return 0, []
    score = [[0] * (len(y) + 1)]
    one = []
    right = [(b.tags[q], b.own[q], b.kids[q], q) for q in y]
    for p in x:
        tag, own, leaf = a.tags[p], a.own[p], not a.kids[p]
        each = [0 if tag != t else 1 + (own == o != "") if leaf or not k else known[p, q][0] for t, o, k, q in right]
        row, before = [0], score[-1]
        for j, s in enumerate(each):
            row.append(max(before[j + 1], row[j], before[j] + s))
        one.append(each)
        score.append(row)
    pairs, i, j = [], len(x), len(y)
    while i and j:
        s = one[i - 1][j - 1]
        if s and score[i][j] == score[i - 1][j - 1] + s:
            pairs.append((x[i - 1], y[j - 1]))
            i, j = i - 1, j - 1
        elif score[i][j] == score[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return score[-1][-1], pairs


def match(a: Outline, b: Outline) -> dict[tuple[int, int], tuple[int, list[tuple[int, int]]]]:
    """Simple tree matching: of pairs of elements their score and which of their children match.

    A pair counts 1, and 1 more if both say the same themselves, and what their children's best matching
    counts. Equal parts match as they are, from both ends of a row.
    """
    known: dict = {}
    open_ = [(0, 0)] if a.tags[0] == b.tags[0] else []
    while open_:
        p, q = pair = open_[-1]
        if pair in known:
            open_.pop()
            continue
        if a.whole[p] == b.whole[q]:
            known[pair] = a.weight[p], list(zip(a.kids[p], b.kids[q], strict=True))
            continue
        x, y = a.kids[p], b.kids[q]
        head, tail = _ends(a, b, x, y)
        same = list(zip(x[:head], y[:head])) + list(zip(x[len(x) - tail :], y[len(y) - tail :]))
        x, y = x[head : len(x) - tail], y[head : len(y) - tail]
        long = _anchored(a, b, x, y) if len(x) * len(y) > PAIRS else None
        if long is not None:
            need = [u for u in long if u not in known]
        else:  # pairs without children on both sides score at sight
            deep = [j for j in y if b.kids[j]]
            need = [(i, j) for i in x if deep and a.kids[i] for j in deep if a.tags[i] == b.tags[j] and (i, j) not in known]
        if need:
            open_ += need
            continue
        total, pairs = (sum(known[u][0] for u in long), long) if long is not None else _paired(a, b, x, y, known)
        equal = a.own[p] == b.own[q] != ""
        known[pair] = 1 + equal + sum(a.weight[k] for k, _ in same) + total, same + pairs
    return known


def aligned(a: Outline, b: Outline) -> dict[int, int]:
    """Which element of the first page each element of the second matches."""
    known = match(a, b)
    out, open_ = {}, [(0, 0)] if known else []
    while open_:
        p, q = open_.pop()
        out[q] = p
        if (p, q) in known:
            open_ += known[p, q][1]
        elif a.whole[p] == b.whole[q]:
            open_ += zip(a.kids[p], b.kids[q], strict=True)
    return out


@lru_cache(64)
def _model(page: str) -> tuple[Outline, list[int]]:
    o = outline(page)
    return o, o.places()


def read(page: str, model: str | None) -> tuple[list, list]:
    """A page's runs (text, slot, key, break before, in a link, in an article) and its furniture.

    slot: where the page's element stands in the model; elements that match none go by their path. key:
    what the element says there. Without a model both are 0.
    """
    o = outline(page)
    if model is None:
        return [(t, 0, 0, b, l, m) for t, _, b, l, m in o.runs], o.furniture
    a, places = _model(model)
    to = aligned(a, o)
    slots: dict[int, tuple[int, int]] = {}
    out = []
    for t, n, b, l, m in o.runs:
        if n not in slots:
            slot = places[to[n]] if n in to else o.path[n]
            slots[n] = (slot, _key(slot, o.own[n])) if o.own[n] else (0, 0)
        out.append((t, *slots[n], b, l, m))
    return out, o.furniture


def text_of(runs: list, furniture: list, template: frozenset[int]) -> str:
    """Blocks of a page, without furniture and template text.

    Furniture that can stand around a whole page goes only if at most half of what varies (in articles, if
    there are some) is in it. If template text outside links outweighs what varies, the pages are copies
    of one article: template text in links and outside the article goes, or, if there is no article, in links only.
    """
    words = [len(r[0].split()) * (not r[4]) for r in runs]
    for weigh in ([w * (r[2] not in template) * r[5] for w, r in zip(words, runs)], [w * (r[2] not in template) for w, r in zip(words, runs)], words):
        if any(weigh):
            break
    sums = [0, *accumulate(weigh)]
    dropped = [False] * len(runs)
    for first, end, around in furniture:
        if not (around and 2 * (sums[end] - sums[first]) > sums[-1]):
            dropped[first:end] = [True] * (end - first)
    fixed = [r[2] in template and r[2] != 0 for r in runs]
    constant = sum(len(r[0]) for r, f, d in zip(runs, fixed, dropped) if f and not d and not r[4])
    varying = sum(len(r[0].strip()) for r, f, d in zip(runs, fixed, dropped) if not f and not d)
    copies = constant > varying
    article = copies and any(r[5] for r, f, d in zip(runs, fixed, dropped) if f and not d)
    out: list[str] = []
    line: list[str] = []
    for (text, _, _, broken, link, inside), f, d in zip(runs, fixed, dropped):
        if broken:
            if whole := " ".join("".join(line).split()):
                out.append(whole)
            line.clear()
        if d:
            continue
        gone = f and (not copies or link or (article and not inside))
        line.append(" " if gone else text)
    if whole := " ".join("".join(line).split()):
        out.append(whole)
    return "\n".join(out)


def extract(page: str | None, model: str | None = None, template: frozenset[int] = frozenset()) -> str:
    """A page's text, read by the page that stands for its layout and the keys of its host's template text."""
    return text_of(*read(page, model), template) if page else ""


@lru_cache(4096)
def _wrapper(text: str) -> frozenset[int]:
    return frozenset(map(int, text.split(",")))


def host(url: Column) -> Column:
    """Lower-case host of an address; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def layout(page: Column) -> Column:
    """Hash of the kinds of elements and classes in a page, without names that change from page to page."""
    tags = F.regexp_extract_all(page, F.lit(r"<([A-Za-z][A-Za-z0-9]*)"), F.lit(1))
    names = F.filter(F.regexp_extract_all(page, F.lit(r"""\s(?:class|id)\s*=\s*["']([^"'<>]{1,80})["']"""), F.lit(1)), lambda n: ~F.rlike(n, F.lit(r"\d")))
    return F.xxhash64(F.array_sort(F.array_distinct(F.transform(tags, lambda t: F.lower(t)))), F.array_sort(F.array_distinct(names)))


def least_share(n: Column, total: Column, z: float = SURE) -> Column:
    """The lower end of the Wilson interval of a share n / total: what it may be, given how few have been seen."""
    p = n / total
    return (p + z * z / (2 * total) - z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total))) / (1 + z * z / total)


def _small(df: DataFrame, text: str) -> DataFrame:
    size = df.agg(F.sum(F.octet_length(text) + 64)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


READ = "page_id long, url string, host string, layout long, h long, runs array<string>, slots array<bigint>, keys array<bigint>, flags binary, furniture array<bigint>"


def aligned_pages(pages: DataFrame) -> DataFrame:
    """READ of every page: its runs of text with slots and keys by the page that stands for its layout."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host(F.col("url")).alias("host"), layout(F.col("html")).alias("layout"), F.xxhash64("html").alias("h"), "html")
    known = rows.where("html IS NOT NULL AND html <> '' AND host <> ''").groupBy("host", "layout").agg(F.min(F.struct("h", "html")).alias("first"))
    known = written(known.select(F.col("host").alias("host_"), F.col("layout").alias("layout_"), F.col("first.html").alias("model")), "layouts")
    rows = rows.join(_small(known, "model"), (F.col("host") == F.col("host_")) & (F.col("layout") == F.col("layout_")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for page, model in zip(b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True):
                runs, furniture = read(page, model) if page else ([], [])
                for c, v in zip(cols, ([r[0] for r in runs], [r[1] for r in runs], [r[2] for r in runs], bytes(r[3] + 2 * r[4] + 4 * r[5] for r in runs), [int(x) for f in furniture for x in f]), strict=True):
                    c.append(v)
            kinds = (pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [x.split()[0] for x in READ.split(", ")])

    small_arrow_batches(pages.sparkSession)
    return rows.select("page_id", "url", "host", "layout", "h", "html", "model").mapInArrow(run, READ)


def wrappers(read_pages: DataFrame) -> DataFrame:
    """(host, layout, wrapper): keys of the template text in a layout's slots, counted over all distinct pages of the host."""
    both = F.arrays_zip(F.col("slots").alias("slot"), F.col("keys").alias("key"))
    seen = F.array_distinct(F.filter(both, lambda x: x["key"] != 0))
    # copies collapse where they are read
    once = read_pages.where("host <> ''").groupBy("host", "h").agg(F.first("layout").alias("layout"), F.first(seen).alias("seen"))
    said = written(once.select("host", "layout", F.inline("seen")).groupBy("host", "layout", "slot", "key").agg(F.count("*").alias("n")), "said")
    # a page says several things in a slot only where elements match none of the model's
    pages = once.select("host", F.explode(F.array_distinct("seen.slot")).alias("slot")).groupBy("host", "slot").agg(F.count("*").alias("total"))
    total = pages.where("total > 1")
    often = said.groupBy("host", "slot", "key").agg(F.sum("n").alias("n")).where("n > 1")
    fixed = written(often.join(total, ["host", "slot"]).where(least_share(F.col("n"), F.col("total")) > 0.5).select(F.col("host").alias("host_"), F.col("key").alias("key_")), "fixed")
    keys = said.join(fixed, (F.col("host") == F.col("host_")) & (F.col("key") == F.col("key_")), "left_semi").groupBy("host", "layout").agg(F.collect_set("key").alias("keys"))
    return keys.select("host", "layout", F.array_join(F.sort_array("keys").cast("array<string>"), ",").alias("wrapper"))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, template_chars) of every page; the last: how much of its text is template.

    The text of a null or empty page is empty. Pages without a host are read without a wrapper.
    Repeated rows are kept; other columns are ignored. Trees of any depth and width are read.
    """
    rows = written(aligned_pages(pages), "read")
    known = written(wrappers(rows).withColumnsRenamed({"host": "host_", "layout": "layout_"}), "wrappers")
    rows = rows.join(_small(known, "wrapper"), (F.col("host") == F.col("host_")) & (F.col("layout") == F.col("layout_")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, template = [], []
            for runs, keys, flags, furniture, wrapper in zip(*(b.column(k).to_pylist() for k in ("runs", "keys", "flags", "furniture", "wrapper")), strict=True):
                all_ = [(t, 0, k, bool(f & 1), bool(f & 2), bool(f & 4)) for t, k, f in zip(runs, keys, flags, strict=True)]
                fixed = _wrapper(wrapper) if wrapper else frozenset()
                texts.append(text_of(all_, [(s, e, bool(a)) for s, e, a in zip(*[iter(furniture)] * 3, strict=True)], fixed))
                template.append(sum(len(r[0].strip()) for r in all_ if r[2] in fixed))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(template, pa.int64())], ["page_id", "url", "text", "n_chars", "template_chars"])

    small_arrow_batches(pages.sparkSession)
    rows = rows.select("page_id", "url", "runs", "keys", "flags", "furniture", "wrapper")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, template_chars long")
