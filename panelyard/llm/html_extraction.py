"""Operator 11, HTML extraction by equivalence classes of tokens over the pages of a host.

Tokens are tags, words and stretches, each told apart by the containers it stands in (their names,
classes and ids). Words alone are tokens in short runs only, as in running text each may be the
article's. Stretches are tokens in every run, however long: each word with both its neighbours, and
the run as a whole. The number of times a token occurs on each page of a host is its occurrence
vector.

1. Vectors are compared by sums of a hash of (page, count), which Spark adds up whatever the
   order, so that no host is gathered anywhere. Tokens of a host with equal vectors are a class;
   a class needs two tokens, one of them a tag, on at least SUPPORT pages. A stretch joins the class
   with its vector. A task hands on only stretches whose vector over its own pages is some tag's of
   the host there, which those of a class always are; others add up to a class's vector by chance at
   most, and step 2 counts them.
2. Classes are put to the pages: one is valid if its tokens come in one and the same order on all
   pages of the host, round by round, and if it is nested: it crosses no valid class of higher
   rank (more pages, then more tokens). Valid classes within each other are the host's template.
   Stretches are put to the pages one by one, so that none of them spoils a class: one is the
   template's if on each page of its class it comes once a round, always at the same place between
   the class's tokens. Pages that share more than COPY_SHARE of their words by one class's stretches
   are copies of one article, and these stretches no template.
3. What lies between neighbouring template tokens are slots. A slot's text is what the template
   does not hold: runs made of template words only are dropped everywhere, single ones outside
   the article. Slots in containers for navigation, adverts, comments and the like hold no
   article. Of the others those in the page's article or main element count; without one, those in
   the host's main container (the deepest that has MAIN_SHARE of all words in slots), else those of
   a container that calls itself content, else all.

Hosts on fewer pages than a template needs go by their own containers alone. Words and stretches
need WORD_PAGES different pages of the host, as a few near copies of one article share its words too;
stretches need as many of their own class. A word of a long run is template text if a stretch of the
template covers it; one or two words between a page's own are the page's.

Defined results. Html NULL or empty: an empty text. Missing end tags and stray ones are taken as
browsers do, an unclosed comment or script lasts to the end. Character references are decoded,
white space within a block becomes one space, blocks are joined by one space in page order; line
breaks and the ends of table cells end a block. Url NULL or without a host: no template. Equal
pages count once for the number of different pages. Repeated rows come out each. An empty table
gives an empty table. Columns other than key, url and html play no part.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm.common import arrow_column, stored, text_batches, text_slices
from panelyard.llm.registry import query
from panelyard.llm.url_filters import url_host

SUPPORT = 3              # pages a class is on, at least
SHARE = 0.01             # of its host's pages a class is on, at least
WORD_PAGES = 16          # different pages of a host whose template may hold words
RUN_WORDS = 12           # words of longer runs are tokens with their neighbours only
COPY_SHARE = 0.8         # of their words that pages share if they are copies of one article
MAIN_SHARE = 0.7         # of a host's words in slots that its main container holds
TASK_TOKENS = 500_000    # sums a task holds before it hands them on
TASK_STRETCHES = 2_000_000   # stretches a task holds before it hands on their sums
LEVELS = 32              # levels of containers among which the main one is looked for
PATHS = 200_000          # containers a worker remembers
PAGES = 64               # pages taken apart at once
BUCKET_BITS = 22         # of a table that tells what a task sees once
LOW = 0xFFF              # bits of a stretch's token that are its container's
_MASK = (1 << 64) - 1

CODES = np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)
CODES = (CODES ^ (CODES >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) ^ (CODES >> np.uint64(32))

# Element kinds (fixed values).
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset(
    "html head body div article section main nav header footer aside form ul ol dl menu table thead tbody tfoot tr td th "
    "caption blockquote figure figcaption details summary dialog fieldset noscript template svg canvas video audio object "
    "select button center address hgroup search".split()
)
IN_HEAD = frozenset("noscript template".split())   # besides RAW and VOID elements
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre option legend".split())
CLOSES_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = frozenset("ul ol menu dl table thead tbody tfoot select".split())
ASIDE = frozenset(
    "head nav footer aside form menu dialog noscript template svg canvas video audio object select button search".split()
)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu menus topbar breadcrumb breadcrumbs "
    "header masthead footer sidebar sidebars aside widget widgets related recommended recommendations share sharing social comment "
    "comments commentlist respond reply replies discussion disqus newsletter subscribe subscription signup login search pagination "
    "pager copyright hidden".split()
)
NOT_WORDS = frozenset("has with no without non not".split())
ARTICLE_WORDS = frozenset("article post entry story".split())
CONTENT = frozenset(
    "content main article post entry story main-content maincontent post-content entry-content article-content article-body "
    "articlebody post-body story-body page-content".split()
)

_TAG = re.compile(
    r"""<(?:!--(?:.*?-->|.*)|[!?][^>]*+(?:>|$)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|$)))""", re.DOTALL
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_TELLING = frozenset("class id role style hidden itemprop".split())
_END = {name: re.compile(f"</{name}(?=[\\s/>]|$)", re.IGNORECASE) for name in RAW}
_CAMEL = re.compile(r"([a-z0-9])([A-Z])")


def aside_class(value: str, in_article: bool) -> bool:
    """Whether a class or id names a container for something other than an article."""
    for name in value.split():
        words = set(re.split(r"[^a-z0-9]+", _CAMEL.sub(r"\1 \2", name).lower()))
        found = words & ASIDE_WORDS
        if found == {"header"} and (in_article or words & ARTICLE_WORDS):
            continue
        if found and not words & NOT_WORDS:
            return True
    return False


class Node:
    """A container: its path's hash and what it is for."""

    __slots__ = ("key", "above", "depth", "aside", "article", "content", "line")

    def __init__(self, above: Node | None, tag: str, attributes: tuple = ()):
        found = dict(reversed(attributes))
        named = " ".join(found.get(n, "") for n in ("class", "id"))
        role = found.get("role", "").lower()
        self.above = above
        self.depth = above.depth + 1 if above else 0
        self.key = xxhash.xxh3_64_intdigest(f"{tag} {re.sub(r'[0-9]{3,}', '0', named)} {role}", above.key if above else 0)
        inside = above.article if above else 0
        hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
        own = tag not in ("html", "body", "article", "main") and aside_class(named, inside > 0)
        page_header = tag == "header" and not inside
        self.aside = bool(above and above.aside) or tag in ASIDE or role in ASIDE_ROLES or own or page_header or hidden
        own = 2 if tag == "article" or role == "article" else 1 if tag == "main" or role == "main" else 0
        self.article = max(inside, own)   # 2 within an article, 1 within a main element
        says = {n.lower() for n in named.split()} & CONTENT or found.get("itemprop", "").lower() == "articlebody"
        self.content = bool(above and above.content) or bool(says and tag not in ("html", "body"))
        line = above.line if above else ()
        self.line = (*line, self.key) if len(line) < LEVELS else line


class Paths:
    """Containers seen so far, so that each is looked at once."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.root, self.children = Node(None, ""), {}

    def child(self, above: Node, tag: str, attributes: str) -> Node:
        told = ()
        if attributes:
            told = tuple((n.lower(), a or b or c) for n, a, b, c in _ATTRIBUTE.findall(attributes) if n.lower() in _TELLING)
        key = (above.key, tag, told)
        node = self.children.get(key)
        if node is None:
            node = self.children[key] = Node(above, tag, told)
        return node


def parse(page: str, paths: Paths) -> list[tuple]:
    """Page in order: (0, token, node) for a tag, (1, words, linked words, node, leaf) for a run."""
    if len(paths.children) > PATHS:
        paths.clear()
    root, out, stack = paths.root, [], []   # of (tag, node, leaf name)
    node, leaf, links, run, linked = root, "", 0, [], []
    at, size, search, open_ = 0, len(page), _TAG.search, Counter()

    def flush():
        words = entities.unescape("".join(run)).split()
        if words:
            out.append((1, words, len(" ".join(linked).split()) if linked else 0, node, leaf))
        run.clear()
        linked.clear()

    def pop(to: int):
        nonlocal node, leaf, links
        while len(stack) > to:
            tag, own, _ = stack.pop()
            open_[tag] -= 1
            if tag == "a":
                links -= 1
            elif tag in CONTAINERS:
                out.append((0, own.key ^ 1, own))
        node, leaf = (stack[-1][1], stack[-1][2]) if stack else (root, "")

    while at < size:
        found = search(page, at)
        begin, end = found.span() if found else (size, size)
        if begin > at:
            text = page[at:begin]
            run.append(text)
            if links:
                linked.append(text)
        if not found:
            break
        at = end
        closing, name, attributes = found.groups()
        if name is None:
            continue
        name = name.lower()
        if closing:
            block = name in CONTAINERS or name in LEAVES
            if block:
                flush()
            for i in range(len(stack) - 1, -1, -1) if open_[name] else ():
                if stack[i][0] == name:
                    if node is not (stack[i - 1][1] if i else root):
                        flush()
                    pop(i)
                    break
                if not block and (stack[i][0] in CONTAINERS or stack[i][0] in LEAVES):
                    break   # a stray end tag of something within a line
                if name in LEAVES and stack[i][0] in CONTAINERS:
                    break
            continue
        attributes = attributes.rstrip(">").strip().rstrip("/")
        if name in RAW:
            end = _END[name].search(page, at)
            at = end.start() if end else size
            continue
        if name in VOID:
            if name in ("br", "hr"):
                flush()
            continue
        if stack and stack[-1][0] == "head" and name not in IN_HEAD:
            flush()
            pop(len(stack) - 1)
        if name in CONTAINERS or name in LEAVES:
            flush()
            # A paragraph or heading ends where the next block starts, and so does what is open in it.
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CONTAINERS or stack[i][0] in ("li", "dt", "dd", "option"):
                    break
                if stack[i][0] in LEAVES:
                    pop(i)
            closes, first = CLOSES_ITSELF.get(name, ()), None
            if closes:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in closes:
                        first = i
                    elif stack[i][0] in LISTS or stack[i][0] == "tr":
                        break
                if first is not None:
                    pop(first)
            if name in CONTAINERS:
                node, leaf = paths.child(node, name, attributes), ""
                out.append((0, node.key, node))
            else:
                leaf = name
                if attributes:
                    inner = paths.child(node, name, attributes)
                    node = inner if inner.aside and not node.aside else node
                out.append((0, xxhash.xxh3_64_intdigest(name, node.key), node))
        elif attributes and not node.aside:
            # Within a line only what is set aside matters.
            inner = paths.child(node, name, attributes)
            if inner.aside:
                flush()
                node = inner
        if name == "a":
            links += 1
        open_[name] += 1
        stack.append((name, node, leaf))
    flush()
    pop(0)
    return out


def word_tokens(words: list[str], node: Node, leaf: str) -> list[int]:
    seed = node.key ^ (len(leaf) + 1) * 0x9E3779B97F4A7C15 & _MASK
    return [xxhash.xxh3_64_intdigest(w, seed) for w in words]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.full(n, base, dtype=np.uint64)]).cumprod(dtype=np.uint64)


def places_in(sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(first, sizes)


def word_hashes(words: list[str]) -> np.ndarray:
    """A hash of each word, from its code points."""
    codes = np.frombuffer((" ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.flatnonzero(codes == 32) + 1   # with the space behind
    first = np.concatenate([[0], ends[:-1]])
    place = places_in(ends - first, first)
    return mixed(np.add.reduceat(CODES[codes & 0xFFFF] * powers(0x9E3779B97F4A7C15, int(place.max()))[place] + codes, first))


def container_seed(item: tuple) -> int:
    return item[3].key ^ (len(item[4]) + 1) * 0x9E3779B97F4A7C15 & _MASK


def stretches(runs: list[tuple[list[str], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All stretches of some runs (words, seed of the container): token, run, and the place of the
    word in the middle, or -1 for the whole run. The low bits of a token are its container's."""
    if not runs:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    size = np.array([len(words) for words, _ in runs], dtype=np.int64)
    seed = np.array([seed for _, seed in runs], dtype=np.uint64)
    first = np.cumsum(size) - size
    word = word_hashes([w for words, _ in runs for w in words])
    left, right = np.concatenate([[np.uint64(0)], word[:-1]]), np.concatenate([word[1:], [np.uint64(0)]])
    left[first] = 0   # nothing stands before a run's first word and after its last
    right[first + size - 1] = 0
    three = left * np.uint64(0xA24BAED4963EE407) + word * np.uint64(0x9FB21C651E98DF25) + right * np.uint64(0xD6E8FEB86659FD93)
    place, own = places_in(size, first), seed & np.uint64(LOW)
    whole = np.add.reduceat(word * powers(0xC2B2AE3D27D4EB4F, int(size.max()))[place], first) + size.astype(np.uint64)
    mark, high = mixed(seed), np.uint64(_MASK ^ LOW)
    token = np.concatenate([(three + np.repeat(mark, size)) & high | np.repeat(own, size), mixed(whole + mark) & high | own])
    run = np.arange(len(runs))
    return token.view(np.int64), np.concatenate([np.repeat(run, size), run]), np.concatenate([place, np.full(len(runs), -1)])


def known_stretches(pages: list[list[tuple]], wanted: list[np.ndarray | None]) -> list[list[tuple[int, int, int]]]:
    """For each page (item, place, token) of the stretches it has of those wanted of it. Runs in
    containers without any are passed over."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in pages]
    at, runs, lows = [], [], {}
    for p, (page, tokens) in enumerate(zip(pages, wanted)):
        if tokens is None or not len(tokens):
            continue
        low = lows.get(id(tokens))
        if low is None:
            low = lows[id(tokens)] = set((tokens & LOW).tolist())
        for i, item in enumerate(page):
            if item[0] == 1:
                seed = container_seed(item)
                if seed & LOW in low:
                    at.append((p, i))
                    runs.append((item[1], seed))
    if runs:
        among = np.unique(np.concatenate([t for t in {id(t): t for t in wanted if t is not None}.values()]))
        token, run, place = stretches(runs)
        hits = np.flatnonzero(among[np.minimum(np.searchsorted(among, token), len(among) - 1)] == token)
        hits = hits[np.lexsort((place[hits], run[hits]))]
        for r, j, t in zip(run[hits].tolist(), place[hits].tolist(), token[hits].tolist()):
            found[at[r][0]].append((at[r][1], j, t))
    return found


def covered(page: list[tuple], found: list[tuple[int, int, int]]) -> dict[int, set[int]]:
    """Item -> places of the words that these stretches hold."""
    out: dict[int, set[int]] = {}
    for item, place, _ in found:
        size = len(page[item][1])
        out.setdefault(item, set()).update(range(size) if place < 0 else range(max(place - 1, 0), min(place + 2, size)))
    return out


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def page_slices(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    """Rows of a batch, a few texts at a time."""
    for lo, hi in text_slices([batch.column("html")]):
        for at in range(lo, hi, PAGES):
            yield list(zip(*(c.to_pylist() for c in batch.slice(at, min(PAGES, hi - at)).columns)))


def sums_batch(names: list[str], sums: dict) -> pa.RecordBatch:
    rows = [(*key, *value) for key, value in sums.items()]
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


VECTORS = ["host", "kind", "token", "pages", "low", "high"]   # kinds: 0 word, 1 tag, 2 stretch


class StretchSums:
    """The stretches of a task's pages, with the hashes of (page, count)."""

    def __init__(self):
        self.size, self.held, self.hosts, self.own = 0, [], [], []

    def add(self, page: list[tuple], host: int, own: int, runs: list, at: list) -> None:
        """A page's runs, for ``runs`` and the page's number for ``at``."""
        for item in page:
            if item[0] == 1:
                runs.append((item[1], container_seed(item)))
                at.append(len(self.own))
        self.hosts.append(host)
        self.own.append(own)

    def close(self, runs: list, at: list) -> None:
        token, run, _ = stretches(runs)
        self.held.append((token, np.array(at, dtype=np.int32)[run]))
        self.size += len(token)

    def batch(self, sums: dict) -> pa.RecordBatch:
        """Sums of the stretches that have the vector of a tag of their host, as far as seen."""
        token, page = (np.concatenate(c) for c in zip(*self.held))
        tags = [(key[0], *value) for key, value in sums.items() if key[1] == 1]
        # What is seen once needs a tag seen once, on its page.
        once = np.array([count_hash(1, own) for own in self.own], dtype=np.uint64)
        low, high = (once & np.uint64(0xFFFFFFFF)).astype(np.int64), (once >> np.uint64(32)).astype(np.int64)
        lone = {tag[2:] for tag in tags if tag[1] == 1}
        lone = np.array([pair in lone for pair in zip(low.tolist(), high.tolist())], dtype=bool)
        for shift in (64 - BUCKET_BITS, 40 - BUCKET_BITS):
            bucket = (token >> np.int64(shift)) & np.int64((1 << BUCKET_BITS) - 1)
            kept = np.flatnonzero((np.bincount(bucket, minlength=1 << BUCKET_BITS) > 1)[bucket] | lone[page])
            token, page = token[kept], page[kept]
        # One row per page and stretch, then one per host and stretch.
        order = np.lexsort((page, token))
        token, page = token[order], page[order]
        first = starts(token, page)
        n = np.diff(np.append(first, len(token)))
        token, page = token[first], page[first]
        low, high = low[page], high[page]
        for i in np.flatnonzero(n > 1).tolist():
            h = count_hash(int(n[i]), self.own[page[i]])
            low[i], high[i] = h & 0xFFFFFFFF, h >> 32
        host = np.array(self.hosts, dtype=np.int64)[page]
        order = np.lexsort((host, token))
        host, token, low, high = (c[order] for c in (host, token, low, high))
        first = starts(host, token)
        if not len(first):
            return sums_batch(VECTORS, {})
        columns = [host[first], np.diff(np.append(first, len(host))), np.add.reduceat(low, first), np.add.reduceat(high, first)]
        kept = np.isin(vector_hash(columns), vector_hash(list(np.array(tags, dtype=np.int64).reshape(-1, 4).T)))
        host, pages, low, high = (c[kept] for c in columns)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (host, np.full(len(host), 2), token[first][kept], pages, low, high)], VECTORS)


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows starts in sorted columns."""
    changed = np.zeros(len(columns[0]), dtype=bool)
    changed[:1] = True
    for column in columns:
        changed[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(changed)


def count_hash(n: int, own: int) -> int:
    return xxhash.xxh3_64_intdigest(n.to_bytes(8, "little"), own)


def vector_hash(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), dtype=np.uint64)
    for column in columns:
        out = mixed(out + column.astype(np.int64).view(np.uint64))
    return out


def vector_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over a task's pages of each token's hashes of (page, count)."""
    paths, sums, size, texts = Paths(), {}, 0, StretchSums()   # sums: pages, high and low in one number

    def made() -> Iterator[pa.RecordBatch]:
        found = {
            (host, kind, signed(token)): (n >> 128, n & _MASK, n >> 64 & _MASK)
            for (host, kind), total in sums.items() for token, n in total.items()
        }
        if texts.held:
            yield texts.batch(found)
        yield sums_batch(VECTORS, found)

    for batch in batches:
        for rows in page_slices(batch):
            runs, at = [], []
            for host, text, with_words in rows:
                own = xxhash.xxh3_64_intdigest(text)
                page = parse(text, paths)
                kinds = [(1, [item[1] for item in page if item[0] == 0])]
                if with_words:
                    short = [word_tokens(item[1], item[3], item[4]) for item in page if item[0] == 1 and len(item[1]) <= RUN_WORDS]
                    kinds.append((0, [token for own_tokens in short for token in own_tokens]))
                    texts.add(page, host, own, runs, at)
                vectors: dict[int, int] = {}
                for kind, tokens in kinds:
                    total = sums.setdefault((host, kind), {})
                    before = len(total)
                    for token, n in Counter(tokens).items():
                        h = vectors.get(n)
                        if h is None:
                            h = count_hash(n, own)
                            h = vectors[n] = 1 << 128 | (h >> 32) << 64 | h & 0xFFFFFFFF
                        total[token] = total.get(token, 0) + h
                    size += len(total) - before
            if runs:
                texts.close(runs, at)
            if size > TASK_TOKENS or texts.size > TASK_STRETCHES:
                yield from made()
                sums, size, texts = {}, 0, StretchSums()
    yield from made()


def packed_classes():
    """Kernel: (class ids, tokens of each, stretches of each) -> arrays as bytes."""

    def kernel():
        def run(ids, tokens, texts):
            first = [np.array(i, dtype=np.int64).tobytes() for i in ids]
            held = [
                made for lists in (tokens, texts) for made in (
                    [np.array([x for t in own for x in t], dtype=np.int64).tobytes() for own in lists],
                    [np.array([len(t) for t in own], dtype=np.int64).tobytes() for own in lists],
                )
            ]
            return first, *held

        return run

    return kernel


def class_of(ids: bytes, tokens: bytes, sizes: bytes) -> dict[int, int]:
    """Token -> id of its class."""
    ids, tokens, sizes = (np.frombuffer(x, dtype=np.int64) for x in (ids, tokens, sizes))
    return dict(zip(tokens.tolist(), np.repeat(ids, sizes).tolist()))


class HostClasses:
    """A host's classes: of tokens, of stretches, and how many tokens each has."""

    def __init__(self, ids: bytes, tokens: bytes, sizes: bytes, texts: bytes, text_sizes: bytes):
        self.tokens, self.texts = class_of(ids, tokens, sizes), class_of(ids, texts, text_sizes)
        self.sizes, self.wanted = Counter(self.tokens.values()), np.frombuffer(texts, dtype=np.int64)


class Templates:
    """What a task knows of the last hosts it met."""

    def __init__(self, make, most: int = 1000):
        self.make, self.most, self.known = make, most, {}

    def get(self, host, *packed):
        if host not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[host] = self.make(*packed)
        return self.known[host]


def template_tokens(page: list[tuple], classes: dict[int, int], with_words: bool) -> Iterator[tuple[int, int, int]]:
    """(token, class, item) of the template's tokens in page order."""
    for i, item in enumerate(page):
        if item[0] == 0:
            token = signed(item[1])
            if token in classes:
                yield token, classes[token], i
        elif with_words and len(item[1]) <= RUN_WORDS:
            for token in map(signed, word_tokens(item[1], item[3], item[4])):
                if token in classes:
                    yield token, classes[token], i


def stretch_places(sequence: list[tuple[int, int, int]], found: list[tuple[int, int, int]], host: HostClasses) -> dict[int, int]:
    """For each stretch a number for its place in a round of its class, 0 if it is not once in each
    round at the same place."""
    passed, seen, at = Counter(), {}, 0
    for item, _, token in found:
        while at < len(sequence) and sequence[at][2] < item:
            passed[sequence[at][1]] += 1
            at += 1
        seen.setdefault(token, []).append(passed[host.texts[token]])
    for _, name, _ in sequence[at:]:
        passed[name] += 1
    places = {}
    for token, before in seen.items():
        k, all_ = host.sizes[host.texts[token]], passed[host.texts[token]]
        same = len(before) * k == all_ and before[0] <= k and all(n == before[0] + i * k for i, n in enumerate(before))
        places[token] = before[0] + 1 if same else 0
    return places


def orders_and_crossings(sequence: list[tuple[int, int]]) -> tuple[dict[int, int], set[tuple[int, int]]]:
    """For each class a number for its tokens' order (0 if rounds differ), and the pairs of
    classes that are not nested."""
    own: dict[int, list[int]] = {}
    for token, name in sequence:
        own.setdefault(name, []).append(token)
    orders, place, size = {}, {}, {}
    for name, tokens in own.items():
        k = len(set(tokens))
        first = tokens[:k]
        whole = len(tokens) % k == 0 and len(set(first)) == k and tokens == first * (len(tokens) // k)
        orders[name] = signed(xxhash.xxh3_64_intdigest(np.array(first, dtype=np.int64).tobytes()) | 1) if whole else 0
        if whole:
            size[name] = k
            place.update((token, i) for i, token in enumerate(first))
    crossings, stack, is_open = set(), [], set()
    for token, name in sequence:
        if name not in size:
            continue
        if place[token] == 0:
            stack.append(name)
            is_open.add(name)
        elif name not in is_open:
            continue   # its round was given up where it crossed another
        else:
            while stack[-1] != name:
                other = stack.pop()
                is_open.discard(other)
                crossings |= {(name, other), (other, name)}
        if place[token] == size[name] - 1 and stack and stack[-1] == name:
            stack.pop()
            is_open.discard(name)
    return orders, crossings


# Kinds: 0 order, 1 crossing, 2 words of a container, 3 place of a stretch, 4 words in a class's stretches.
CHECKS = ["host", "kind", "a", "b", "n", "m"]


def check_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A host's classes on a task's pages: orders, crossings, places of stretches, and the words in slots."""
    paths, sums, known = Paths(), {}, Templates(HostClasses)
    for batch in batches:
        for slice_rows in page_slices(batch):
            parsed = [(host, words, known.get(host, *packed), parse(text, paths)) for host, text, words, *packed in slice_rows]
            found = known_stretches([page for *_, page in parsed], [own.wanted for _, _, own, _ in parsed])
            for (host, words, own, page), hits in zip(parsed, found):
                for key, n, m in page_checks(host, page, words, own, [h for h in hits if h[2] in own.texts]):
                    total = sums.setdefault(key, [0, 0])
                    total[0] += n
                    total[1] += m
            if len(sums) > TASK_TOKENS:
                yield sums_batch(CHECKS, sums)
                sums = {}
    yield sums_batch(CHECKS, sums)


def page_checks(host: int, page: list[tuple], words: bool, own: HostClasses, found: list[tuple[int, int, int]]) -> list[tuple]:
    """(key, n, m) of one page."""
    classes = own.tokens
    sequence = list(template_tokens(page, classes, words))
    orders, crossings = orders_and_crossings([step[:2] for step in sequence])
    rows = [((host, 0, name, order), 1, 0) for name, order in orders.items()]
    rows += [((host, 1, a, b), 1, 0) for a, b in crossings]
    held = {}
    if found:
        rows += [((host, 3, token, place), 1, 0) for token, place in stretch_places(sequence, found, own).items()]
        shown = {i: len(item[1]) for i, item in enumerate(page) if item[0] == 1 and not item[3].aside}
        all_, by_class = sum(shown.values()), {}
        for hit in found:
            by_class.setdefault(own.texts[hit[2]], []).append(hit)
        for name, hits in by_class.items():
            rows.append(((host, 4, name, 0), sum(len(c) for i, c in covered(page, hits).items() if i in shown), all_))
        held = covered(page, found)
        if sum(len(c) for i, c in held.items() if i in shown) > COPY_SHARE * all_:
            held = {}
    for i, item in enumerate(page):
        if item[0] == 1 and not item[3].aside:
            number = len(item[1])
            if words and number <= RUN_WORDS:
                number = sum(signed(t) not in classes and j not in held.get(i, ()) for j, t in enumerate(word_tokens(*item[1:2], *item[3:])))
            elif i in held:
                number -= len(held[i])
            rows += [((host, 2, signed(key), depth), number, min(number, item[2])) for depth, key in enumerate(item[3].line)]
    return rows


def page_slots(page: list[tuple], template: frozenset, with_words: bool, main: int | None, held: dict[int, set[int]]) -> list[tuple[int, bool, str]]:
    """(slot, whether it belongs to the article, text) of each run that the template leaves. ``held``:
    places of words in the template's stretches, by item."""
    runs, slot = [], 0
    for i, item in enumerate(page):
        if item[0] == 0:
            slot += signed(item[1]) in template
            continue
        _, words, linked, node, leaf = item
        if with_words:
            fixed = [j in held[i] for j in range(len(words))] if i in held else [False] * len(words)
            if len(words) <= RUN_WORDS:
                fixed = [f or signed(t) in template for f, t in zip(fixed, word_tokens(words, node, leaf))]
            if any(fixed):
                if all(fixed) or not node.article:
                    words = [w for w, f in zip(words, fixed) if not f]
                slot += sum(fixed)
        if words:
            runs.append((slot, " ".join(words), node, linked > len(words) / 2))
    own = [not node.aside for _, _, node, _ in runs]
    for wanted in (
        lambda node: node.article == 2,
        lambda node: node.article == 1,
        lambda node: main is not None and node.depth > 1 and main in node.line,
        lambda node: node.content,
    ):
        chosen = [ok and wanted(node) for ok, (_, _, node, _) in zip(own, runs)]
        if any(chosen):
            own = chosen
            break
    else:
        own = [ok and not links for ok, (_, _, _, links) in zip(own, runs)]
    return [(slot, ok, text) for ok, (slot, text, _, _) in zip(own, runs)]


def text_kernel(with_slots: bool):
    def kernel():
        paths, known = Paths(), Templates(lambda tokens: (frozenset((own := np.frombuffer(tokens, dtype=np.int64)).tolist()), own))

        def run(pages, hosts, tokens, words, mains):
            texts, slots = [], []
            for at in range(0, len(pages), PAGES):
                few = slice(at, at + PAGES)
                parsed = [parse(page or "", paths) for page in pages[few]]
                templates = [known.get(host, own or b"") if host is not None else (frozenset(), None) for host, own in zip(hosts[few], tokens[few])]
                found = known_stretches(parsed, [own if with_words else None for (_, own), with_words in zip(templates, words[few])])
                for page, hits, (template, _), with_words, main in zip(parsed, found, templates, words[few], mains[few]):
                    held = covered(page, [h for h in hits if h[2] in template])
                    runs = page_slots(page, template, bool(with_words), None if main is None else main & _MASK, held)
                    texts.append(" ".join(text for _, ok, text in runs if ok))
                    slots.append([{"slot": s, "article": ok, "text": text} for s, ok, text in runs] if with_slots else None)
            return [texts, [len(t) for t in texts]] + ([slots] if with_slots else [])

        return run

    return kernel


def deduce_templates(pages: DataFrame) -> DataFrame:
    """One row per host with a template: host, tokens (as bytes), words (whether it may hold
    words), main (path hash of the main container, or NULL). ``pages``: host, html."""
    own = pages.groupBy("host", F.xxhash64("html").alias("own")).agg(F.count("*").alias("all"))
    hosts = own.groupBy("host").agg(F.sum("all").alias("all"), F.count("*").alias("different"))
    hosts = stored(hosts.filter(F.col("different") >= SUPPORT).withColumn("words", F.col("different") >= WORD_PAGES))
    # Only hosts with words are looked up here, which are few beside their pages.
    large = hosts.filter("words").select(F.col("host").alias("of"), "words")
    asked = pages.join(large, pages["host"] == large["of"], "left").select("host", "html", F.col("words").isNotNull().alias("words"))
    sums = asked.mapInArrow(vector_task, ", ".join(f"{c} long" for c in VECTORS)).groupBy("host", "kind", "token").agg(
        *[F.sum(c).alias(c) for c in VECTORS[3:]]
    )
    sums = stored(sums.filter(F.col("pages") >= F.when(F.col("kind") == 2, WORD_PAGES).otherwise(SUPPORT)))   # only what is on enough pages is written
    vectors = sums.join(hosts, "host").filter(F.col("pages") >= F.greatest(F.lit(SUPPORT), SHARE * F.col("all")))
    single, kind = F.when(F.col("kind") < 2, F.col("token")), F.when(F.col("kind") < 2, F.col("kind"))
    classes = vectors.groupBy("host", "words", "pages", "low", "high").agg(
        F.min(single).alias("id"), F.collect_list(single).alias("tokens"), F.max(kind).alias("tag"),
        F.collect_list(F.when(F.col("kind") == 2, F.col("token"))).alias("texts"),
    )
    classes = classes.filter((F.size("tokens") + F.size("texts") > 1) & (F.col("tag") == 1))
    classes = stored(classes.select("host", "words", "id", "tokens", "texts", "pages"))
    held = classes.groupBy("host", "words").agg(F.collect_list(F.struct("id", "tokens", "texts")).alias("c"))
    packed = arrow_column(
        packed_classes(), "ids binary, tokens binary, sizes binary, texts binary, text_sizes binary", F.col("c.id"), F.col("c.tokens"), F.col("c.texts")
    )
    held = stored(held.select("host", "words", packed.alias("p")).select(F.col("host").alias("of"), "words", "p.*"))

    # One row of the right side for each host, so a host's pages may be split as often as needed.
    put = pages.join(held, pages["host"] == held["of"]).select("host", "html", "words", "ids", "tokens", "sizes", "texts", "text_sizes")
    checks = put.mapInArrow(check_task, ", ".join(f"{c} long" for c in CHECKS)).groupBy("host", "kind", "a", "b").agg(
        F.sum("n").alias("n"), F.sum("m").alias("m")
    )
    checks = stored(checks)
    ordered = checks.filter("kind = 0").groupBy("host", F.col("a").alias("id")).agg(F.count("*").alias("orders"), F.min(F.col("b") != 0).alias("whole"))
    ordered = stored(classes.join(ordered.filter("orders = 1 and whole").select("host", "id"), ["host", "id"]))
    rank = F.struct("pages", F.size("tokens"), -F.col("id")).alias("rank")
    ranked = ordered.select("host", "id", rank)
    crossed = checks.filter("kind = 1").select("host", F.col("a").alias("id"), F.col("b").alias("other"))
    crossed = crossed.join(ranked, ["host", "id"]).join(
        ranked.select("host", F.col("id").alias("other"), F.col("rank").alias("over")), ["host", "other"]
    ).filter("over > rank").select("host", "id").distinct()
    valid = ordered.join(crossed, ["host", "id"], "left_anti")

    copies = checks.filter("kind = 4").filter(F.col("n") > COPY_SHARE * F.col("m")).select("host", F.col("a").alias("id"))
    texts = valid.join(copies, ["host", "id"], "left_anti").select("host", "words", "pages", F.explode("texts").alias("token"))
    placed = checks.filter("kind = 3").groupBy("host", F.col("a").alias("token")).agg(
        F.count("*").alias("places"), F.min("b").alias("place"), F.sum("n").alias("on")
    )
    texts = texts.join(placed.filter("places = 1 and place > 0"), ["host", "token"]).filter(F.col("on") == F.col("pages"))
    texts = texts.groupBy("host", "words").agg(F.collect_list("token").alias("tokens"))
    tokens = valid.filter(F.size("tokens") > 1).select("host", "words", "tokens").unionByName(texts)
    tokens = tokens.groupBy("host", "words").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))

    slots = checks.filter("kind = 2").select("host", F.col("a").alias("path"), F.col("b").alias("depth"), "n", "m")
    everything = slots.filter("depth = 0").select("host", F.col("n").alias("total"))
    large = slots.join(everything, "host").filter((F.col("n") >= MAIN_SHARE * F.col("total")) & (F.col("m") * 2 <= F.col("n")) & (F.col("depth") > 2))
    mains = large.groupBy("host").agg(F.max_by("path", F.struct("depth", "n", "path")).alias("main"))

    def pack():
        return lambda rows: ([np.array(r or [], dtype=np.int64).tobytes() for r in rows],)

    found = tokens.join(mains, "host", "left")
    return stored(found.select("host", "words", "main", arrow_column(pack, "tokens binary", "tokens")["tokens"].alias("tokens")))


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", with_slots: bool = False) -> DataFrame:
    """(key, url, text, n_chars) of every row, with ``with_slots`` also the slots' texts."""
    text_batches(pages.sparkSession)
    address = F.col(f"`{url}`").cast("string")
    host = url_host(address)
    rows = pages.select(
        F.col(f"`{key}`").alias("id"), address.alias("url"), F.when(host != "", F.xxhash64(host)).alias("host"),
        F.col(f"`{html}`").cast("string").alias("html"),
    )
    templates = deduce_templates(rows.filter("host is not null and html <> ''").select("host", "html"))
    held = templates.withColumnRenamed("host", "of")
    put = rows.join(held, rows["host"] == held["of"], "left")
    slots = ", slots array<struct<slot:long,article:boolean,text:string>>" if with_slots else ""
    made = arrow_column(text_kernel(with_slots), "text string, n_chars long" + slots, "html", "host", "tokens", "words", "main")
    return put.select("id", "url", made.alias("m")).select(F.col("id").alias(key), F.col("url").alias(url), "m.*")


@query()
def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
