"""Operator 2: main text of web pages by deduction of templates from equivalence classes of tokens.

Pages of a host come from a template. Tokens are tags with their path and text blocks with theirs.
Tokens with the same occurrence vector, their counts on every page of the host, form an equivalence
class; vectors are compared by a mergeable fingerprint, the sum of a hash of (page, count) modulo a prime,
so counts are pre-aggregated and no host's pages meet in one task. Classes of MIN_TOKENS on at least
MIN_PAGES different pages are valid, so each type of pages of a host has a template of its own; on half of
the host's pages one token is enough. They nest: a class whose tokens lie within the elements of another,
and repeat where it doesn't, is a list inside it. What isn't a template token fills its slots.

Elements of the template hold slots, and the main slot is found from the root: an element of CONTAINERS
that stands once on its pages, or an article, and holds more than half of the text around it, over all
pages of the host, is entered, unless a heading of changing text stands beside it. The text of a page is
what fills its main slot; where the descent ends at the body, all slots. An article (article, main, or a
role of main) outside the main slot speaks against it, and then all slots are taken.

Slots lose the text of the host's template and elements that are no main text: EXCLUDED, and those whose
class, id or role has a name of boilerplate (UNWANTED, alone or with a word of AFFIXES) and that stand on
MIN_PAGES different pages of the host or more; a host with fewer pages can't tell, and there the name
decides. Such a name around an article counts only where another article with text is free of it.
Template text in an article goes where an element of NEUTRAL with a class, id or role inside the article
holds it; in other elements it is the author's and is kept even where many pages of a host share it. Equal
pages count once, and a page whose slots would be less than a tenth of it beside text of classes on fewer
than half of the host's pages is a near copy of others rather than of their type, and keeps that text.

Where there is no template, on hosts of fewer than MIN_PAGES different pages and on pages without their
host's main slots, articles decide: they are the main text unless the slots outside of them hold more than
the largest of them; then all slots are.

A block ends at tags of BLOCKS. Character references are decoded, white space in a block becomes one
space, and blocks are joined by a newline in page order.

Defined results: null html is empty; a page without text gives an empty text; a null url is a host of
its own; repeated rows are extracted each; an empty table gives an empty result; other columns are
ignored; tags that never close end with the element around them, unclosed comments, scripts and
styles with the page; a page is parsed in time proportional to its length, however its quotes and tags
stand; the < of a tag with a quote that never closes is text.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.shared import scratch, written

#: Elements whose content is never main text.
EXCLUDED = frozenset(
    "nav header footer aside form script style noscript template svg iframe object button select option textarea "
    "head title menu dialog canvas audio video map datalist".split()
)
#: Elements whose content is no markup; it ends at their end tag only.
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that end a block.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Names in class, id and role of elements that are no main text.
UNWANTED = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising advertorial sponsor sponsored promo promos promotion banner banners "
    "menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars aside complementary header headers masthead topbar footer footers "
    "contentinfo notice notices cookie cookies consent gdpr alert alerts warning disclaimer comment comments commentlist discussion disqus respond "
    "replies reply newsletter subscribe subscription signup login share sharing social related recommended recirc popup modal overlay widget widgets "
    "toolbar search pagination pager skip".split()
)
#: Words that such a name may have beside it, as in ad-box or site-footer.
AFFIXES = frozenset("bar block box container links list site".split())
#: Elements that end where the next of their kind starts.
REPEATED = frozenset("li dt dd tr td th".split())
ARTICLE = frozenset(("article", "main"))
#: Elements without a meaning of their own, of which templates are built.
NEUTRAL = frozenset("div span ul ol a".split())
#: Elements that can hold a main slot, and headings, which aren't left outside of one.
CONTAINERS = frozenset("div section article main center td".split())
HEADINGS = frozenset("h1 h2 h3".split())
MIN_PAGES = 3
MIN_TOKENS = 2
#: Fingerprints are sums modulo this prime.
PRIME = (1 << 61) - 1
#: Text of a type of pages that is more than so many times the rest of a page is no template.
COPIED = 9
#: Templates are broadcast up to this size; beyond it they are joined by host.
BROADCAST_BYTES = 8 << 20

#: A tag without < or > in its attributes, and what is no start or end tag.
_PLAIN = re.compile(r"<(/?)([A-Za-z][^\s/<>]*+)((?:[^<>\"']|\"[^<>\"]*+\"|'[^<>']*+')*+)>")
_OTHER = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?/][^>]*>?", re.S)
_SPECIAL = re.compile(r"[>\"']")
_NAME_END = re.compile(r"[\s/>]")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def attributes(text: str) -> tuple[str, bool, bool]:
    """Class, id and role as written, whether one is a name of boilerplate, and whether the role is main."""
    if "=" not in text:
        return "", False, False
    found = [(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")) for m in _ATTRIBUTE.finditer(text)]
    if not found:
        return "", False, False
    return ";".join(value for _, value in found), any(boilerplate(name) for _, value in found for name in value.split()), ("role", "main") in found


def boilerplate(name: str) -> bool:
    """Whether all words of a name are of boilerplate or affixes to one that is."""
    if name in UNWANTED:
        return True
    words = {w.lower() for w in _WORDS.findall(name)}
    return not words.isdisjoint(UNWANTED) and words <= UNWANTED | AFFIXES


class Markup:
    """Finds the tags of a page from left to right, in time proportional to the page.

    A tag ends at the first > outside of quotes. A quote that never closes, of any tag before it, makes
    the < text, or the whole rest a cut off tag where no > follows. Most tags match _PLAIN, which looks no
    further than the next < or >. For others, what follows a quote or > outside of quotes hangs on its place
    alone, so it is found once and kept.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in "\"'>"}
        self.special = (0, -1)  # no special character in between
        self.name_end = (0, -1)
        self.ends: dict[int, int] = {}

    def _after(self, at: int) -> int:
        m = _SPECIAL.search(self.page, at)
        return m.start() if m else -1

    def _tag_end(self, at: int) -> int:
        """Where the tag whose attributes start here has its >, -1 if nowhere."""
        if not self.special[0] <= at <= self.special[1]:
            self.special = (at, self._after(at))
        way, s = [], self.special[1]
        while s >= 0 and s not in self.ends:
            way.append(s)
            c = self.page[s]
            if c == ">":
                self.ends[s] = s
            elif s == self.last[c]:
                self.ends[s] = -1
            else:
                s = self._after(self.page.index(c, s + 1) + 1)
        end = self.ends[s] if s >= 0 else -1
        for k in way:
            self.ends[k] = end
        return end

    def find(self, at: int) -> tuple[int, int, bool, str | None, str]:
        """The next markup from `at`: start, end, whether it is an end tag, its name (None: no tag) and attributes. Start is the page's length if there is none."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            m = _PLAIN.match(page, start)
            if m:
                return start, m.end(), bool(m[1]), m[2], m[3]
            name_at = start + 1 + page.startswith("/", start + 1)
            first = page[name_at : name_at + 1]
            if "a" <= first.lower() <= "z" and first.isascii():
                if not self.name_end[0] <= name_at <= self.name_end[1]:
                    m = _NAME_END.search(page, name_at)
                    self.name_end = (name_at, m.start() if m else len(page))
                name_to = self.name_end[1]
                end = self._tag_end(name_to)
                if end >= 0:
                    return start, end + 1, name_at > start + 1, page[name_at:name_to], page[name_to:end]
                if name_at == start + 1:
                    if self.last[">"] < start:
                        return start, len(page), False, None, ""
                    at = start + 1
                    continue
            m = _OTHER.match(page, start)
            if m:
                return start, m.end(), False, None, ""
            at = start + 1
        return len(page), len(page), False, None, ""


class Block:
    """article: the number of the outermost article around it, 0 for none; marked: whether an element of NEUTRAL with a label inside the article holds it;
    around, within: whether an element with a name of boilerplate that counts holds it outside or inside of the innermost article; main: whether a main slot holds it."""

    __slots__ = ("around", "article", "main", "marked", "path", "text", "wanted", "within")

    def __init__(self, text: str, path: str, article: int, marked: bool, wanted: bool, around: bool, within: bool, main: bool):
        self.text, self.path, self.article, self.marked, self.wanted, self.around, self.within, self.main = text, path, article, marked, wanted, around, within, main


def parsed(page: str, mains: frozenset[str] = frozenset(), names: frozenset[str] | None = None) -> tuple[list[Block], Counter, Counter]:
    """The page's text blocks in order, how often each of its tokens occurs, and how many characters of text the
    elements of a tag token hold, without those in EXCLUDED. names: the tokens of names of boilerplate that count, None: all."""
    blocks: list[Block] = []
    tokens: Counter = Counter()
    inside: Counter = Counter()
    stack: list[tuple] = [("", "", 0, False, True, False, False, False)]  # name and what a block has
    held = [0]  # characters in each element of the stack
    opened: dict[str, list[int]] = defaultdict(list)  # where on the stack the elements of a name are
    open_blocks: list[int] = []
    articles = 0
    parts: list[str] = []
    at, n = 0, len(page)

    def end_block() -> None:
        if parts:
            text = "".join(parts)
            parts.clear()
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                _, path, *rest = stack[-1]
                blocks.append(Block(text, path, *rest))
                if blocks[-1].wanted:
                    held[-1] += len(text)
                tokens[f"#{path}#{_short(text)}"] += 1

    def close(k: int) -> None:
        while len(stack) > k:
            element = stack.pop()
            opened[element[0]].pop()
            own = held.pop()
            inside[element[1]] += own
            held[-1] += own
        while open_blocks and open_blocks[-1] >= k:
            open_blocks.pop()

    markup = Markup(page)
    while at < n:
        start, end, closes, name, attributes_ = markup.find(at)
        if start > at:
            parts.append(page[at:start])
        at = end
        if name is None:  # comment, doctype, or what is no tag
            continue
        name = name.lower()
        if name in BLOCKS or name in EXCLUDED:
            end_block()
        if closes:
            if opened.get(name):
                close(opened[name][-1])
            continue
        label, unwanted, main = attributes(attributes_)
        if name in BLOCKS:  # a paragraph ends where a block starts, an item where the next starts
            k = open_blocks[-1] if open_blocks else 0
            if k and (stack[k][0] == "p" or stack[k][0] == name and name in REPEATED) and name != "br":
                close(k)
        _, path, article, marked, wanted, around, within, in_main = stack[-1]
        own = f"{path}/{name}.{label}" if label else f"{path}/{name}"
        if len(own) > 400:
            own = f"{path[:100]}~{_short(own)}"
        tokens[own] += 1
        if name in RAW:
            m = _ENDS[name].search(page, at)
            at = m.end() if m else n
            continue
        if name in VOID or attributes_.endswith("/") and name not in BLOCKS:
            continue
        is_article = name in ARTICLE or main
        if is_article:
            around, within = around or within, False
        elif unwanted and name not in ("html", "body"):
            named = f"!{name}.{label}"
            tokens[named] += 1
            within = within or names is None or named in names
        if article:
            marked = marked or bool(label) and name in NEUTRAL
        elif is_article:
            articles += 1
            article = articles
        opened[name].append(len(stack))
        if name in BLOCKS:
            open_blocks.append(len(stack))
        stack.append((name, own, article, marked, wanted and name not in EXCLUDED, around, within, in_main or own in mains))
        held.append(0)
    end_block()
    close(1)
    return blocks, tokens, inside


_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}


def _short(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest()


def main_text(page: str, template: frozenset[str] | None, typed: frozenset[str] = frozenset(), mains: frozenset[str] = frozenset()) -> str:
    """The main text of a page of a host with these template tokens, None if it has too few pages for any, those of its types of pages, and its main slots."""
    blocks = parsed(page, mains, template)[0]
    tokens = frozenset() if template is None else template
    slots, of_type = [], set()
    for b in blocks:
        if b.wanted and not b.within:
            if not b.article or b.marked:
                token = f"#{b.path}#{_short(b.text)}"
                if token in tokens:
                    continue
                if token in typed:
                    of_type.add(b)
            slots.append(b)
    if of_type and sum(len(b.text) for b in of_type) <= COPIED * sum(len(b.text) for b in slots if b not in of_type):
        slots = [b for b in slots if b not in of_type]
    free = [b for b in slots if not b.around]
    if any(b.article for b in free):
        slots = free
    if any(b.main for b in slots):
        if not any(b.article and not b.main for b in slots):
            slots = [b for b in slots if b.main]
    elif template is None or mains:
        size: Counter = Counter()
        for b in slots:
            size[b.article] += len(b.text)
        outside = size.pop(0, 0)
        if size and max(size.values()) >= outside:
            slots = [b for b in slots if b.article]
    return "\n".join(b.text for b in slots)


def host_of(url: str = "url"):
    """The host of a URL, lower case and without user and port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _hash(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little", signed=True)


def occurrences(pages: DataFrame) -> DataFrame:
    """host, token, pages, vector (fingerprint), most, chars (in its elements), different: the occurrence vector of every token of a host, and up to MIN_PAGES different pages."""
    names = ["host", "token", "pages", "vector", "most", "chars", "different"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str], list] = defaultdict(lambda: [0, 0, 0, 0, ()])
            for host, page_id, page in zip(*(c.to_pylist() for c in batch.columns)):
                content = _hash(page or "")  # rows with one id are pages of their own unless they are equal
                own = {n: _hash(page_id, content, n) for n in range(1, 5)}
                _, tokens, inside = parsed(page or "")
                tokens["*"] = 1  # counts the host's pages
                for token, n in tokens.items():
                    x = found[host, token]
                    x[0] += 1
                    x[1] = (x[1] + (own[n] if n in own else own.setdefault(n, _hash(page_id, content, n)))) % PRIME
                    x[2] = max(x[2], n)
                    x[3] += inside.get(token, 0)
                    if len(x[4]) < MIN_PAGES and content not in x[4]:
                        x[4] = (*x[4], content)
            keys = list(found)
            columns = [[k[0] for k in keys], [k[1] for k in keys], *([found[k][i] for k in keys] for i in range(5))]
            kinds = (pa.string(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    schema = "host string, token string, pages long, vector long, most long, chars long, different array<long>"
    rows = pages.select(host_of().alias("host"), "page_id", "html").mapInArrow(count, schema)
    different = F.slice(F.array_distinct(F.flatten(F.collect_list("different"))), 1, MIN_PAGES)
    vector = F.pmod(F.sum(F.col("vector").cast("decimal(20,0)")), F.lit(PRIME)).cast("long")
    return rows.groupBy("host", "token").agg(
        F.sum("pages").alias("pages"), vector.alias("vector"), F.max("most").alias("most"), F.sum("chars").alias("chars"), different.alias("different")
    )


def classes(vectors: DataFrame) -> DataFrame:
    """host, tokens, chars (of each), pages, most, wide: the valid equivalence classes of tokens on MIN_PAGES different pages, and whether half of the host's pages have them."""
    tokens = vectors.filter(~F.col("token").startswith("!") & (F.col("token") != "*"))
    hosts = vectors.filter(F.col("token") == "*").select("host", F.col("pages").alias("all"))
    own = tokens.groupBy("host", "vector", "pages", "most").agg(F.array_sort(F.collect_list(F.struct("token", "chars"))).alias("own"))
    found = own.join(hosts, "host").withColumn("wide", 2 * F.col("pages") >= F.col("all"))
    valid = found.filter(F.col("wide") | (F.size("own") >= MIN_TOKENS))
    return valid.select("host", F.col("own.token").alias("tokens"), F.col("own.chars").alias("chars"), "pages", "most", "wide")


def path_of(token: str) -> str:
    return token.split("#")[1] if token.startswith("#") else token


def nested(own: list[list[str]]) -> list[int | None]:
    """For each class the class that it is nested in: the one with the deepest element around all its tokens."""
    holder = {t: k for k, tokens in enumerate(own) for t in tokens if not t.startswith("#")}  # a tag is in one class
    out: list[int | None] = []
    for k, tokens in enumerate(own):
        ps = [path_of(t) for t in tokens]
        shared = ps[0]
        for p in ps[1:]:
            while not p.startswith(shared):
                shared = shared.rpartition("/")[0]
        around = shared if shared not in ps or tokens[0].startswith("#") else shared.rpartition("/")[0]
        while around and holder.get(around, k) == k:
            around = around.rpartition("/")[0]
        out.append(holder[around] if around else None)
    return out


def template_of(own: list[tuple[list[str], int, int]]) -> list[str]:
    """Tokens of the classes (tokens, pages, most a page) that are a root, once on each of their pages, or nested in one."""
    within = nested([tokens for tokens, _, _ in own])
    kept: list[str] = []
    for k, (tokens, _, _) in enumerate(own):
        top, seen = k, {k}
        while within[top] is not None and within[top] not in seen:
            top = within[top]
            seen.add(top)
        if own[top][2] == 1:
            kept += tokens
    return sorted(kept)


def main_slots(own: list[tuple[list[str], list[int], int, int]], kept: set[str]) -> list[str]:
    """Tag tokens of the main slots: of the classes (tokens, chars, pages, most a page), kept the template's tokens.

    From the body down, while one element of the template holds more than half of the text around it on
    its pages and no heading of changing text stands beside it.
    """
    of = {t: (n, pages, most) for tokens, chars, pages, most in own for t, n in zip(tokens, chars) if not t.startswith("#")}
    fixed = {path_of(t) for t in kept if t.startswith("#")}
    children: dict[str, list[str]] = defaultdict(list)
    headings: dict[str, list[str]] = defaultdict(list)

    def name_of(path: str) -> str:
        return path.rpartition("/")[2].partition(".")[0]

    for path in of:
        parent = path.rpartition("/")[0]
        if name_of(path) in HEADINGS and path not in fixed:
            headings[parent].append(path)
        while parent and parent not in kept:
            parent = parent.rpartition("/")[0]
        if path in kept:
            children[parent].append(path)
    found, todo = [], [p for p in of if name_of(p) == "body" and p in kept] or [p for p in children[""] if name_of(p) in CONTAINERS]
    while todo:
        path = todo.pop()
        chars, pages, _ = of[path]
        inner = []
        for child in children[path]:
            n, on, most = of[child]
            fits = name_of(child) in CONTAINERS and (most == 1 or name_of(child) in ARTICLE) and 2 * n * pages > chars * on
            if fits and not headings[path]:
                inner.append(child)
        if not inner and name_of(path) not in ("html", "body"):
            found.append(path)
        todo += inner
    return sorted(found)


def deduced(own: list[tuple[list[str], list[int], int, int, bool]]) -> tuple[list[str], list[str], list[str]]:
    """Text tokens of the template on half of the host's pages, those on fewer, and the main slots, of the classes
    (tokens, chars, pages, most a page, wide)."""
    kept = set(template_of([(tokens, pages, most) for tokens, _, pages, most, _ in own]))
    texts = [sorted(t for tokens, _, _, _, wide in own if wide == w for t in tokens if t.startswith("#") and t in kept) for w in (True, False)]
    return *texts, main_slots([x[:4] for x in own], kept)


def templates(pages: DataFrame) -> DataFrame:
    """host, template, typed, mains: text tokens of the host's nested classes, on half of its pages or fewer, its repeated elements with a name of boilerplate, and its main slots.

    Only hosts of MIN_PAGES different pages or more are in it.
    """

    def nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [deduced([(x["tokens"], x["chars"], x["pages"], x["most"], x["wide"]) for x in xs]) for xs in batch["own"].to_pylist()]
            kind = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch["host"], *(pa.array([f[k] for f in found], kind) for k in range(3))], ["host", "template", "typed", "mains"])

    vectors = written(occurrences(pages).filter(F.size("different") >= MIN_PAGES).drop("different"), "occurrences")
    own = classes(vectors).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("tokens", "chars", "pages", "most", "wide"))).alias("own"))
    found = own.mapInArrow(nest, "host string, template array<string>, typed array<string>, mains array<string>")
    named = vectors.filter((F.col("token") == "*") | F.col("token").startswith("!")).groupBy("host").agg(F.collect_list("token").alias("named"))
    none = F.array().cast("array<string>")
    return named.join(found, "host", "left").select(
        "host", F.concat("named", F.coalesce("template", none)).alias("template"), F.coalesce("typed", none).alias("typed"), F.coalesce("mains", none).alias("mains")
    )


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    with scratch(pages.sparkSession) as kept:
        template = written(templates(pages), "templates")
        kept.append(template.written_path)
    size = template.agg(F.coalesce(F.sum(F.octet_length(F.concat_ws(" ", "template", "typed", "mains"))), F.lit(0))).first()[0]
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of().alias("host"), "html")
    joined = rows.join(F.broadcast(template) if size <= BROADCAST_BYTES else template.hint("merge"), "host", "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in batches:
            page_ids, urls, hosts, pages_, *deduced_ = batch.columns
            texts = []
            for i, page in enumerate(pages_):
                host = hosts[i].as_py()
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = tuple(frozenset(c[i].as_py()) for c in deduced_) if deduced_[0][i].is_valid else (None,)
                texts.append(main_text(page.as_py() or "", *known[host]))
            yield pa.RecordBatch.from_arrays(
                [page_ids, urls, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return joined.select("page_id", "url", "host", "html", "template", "typed", "mains").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
