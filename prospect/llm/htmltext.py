"""Main text of web pages by template deduction (operator 2).

Pages are cut into tokens: tags (told apart by the structural elements around
them and by their class or id) and runs of text between tags.  The vector of a
token's occurrences over a host's pages is summarised as its number of pages
and a hash of (page, times) over them; tokens of a host with equal summaries
form an equivalence class.  Hosts with fewer than ``MIN_PAGES`` pages share one
pool.

*Classes.*  Classes found on at least ``SUPPORT`` of the host's pages, with two
tokens or more, are candidates.  Those found once per page are ordered together:
the candidates of every page, in its order, are counted by distinct order, and the
order of most pages is the host's (classes it lacks are left out), so a class held
by fewer pages nests where its tokens stand between those of a class held by more.
Every distinct order is compared with it: the tokens outside a longest run in
common are out of place on its pages.  Tokens in place on fewer than ``SUPPORT`` of
the host's pages are split off their class, and classes left with one token go.
Classes found several times a page are valid if their instances hold every token
once, in one order, inside one slot and uncrossed, on ``SUPPORT`` of the pages.

*Roles.*  Consecutive tokens of the valid classes bound slots, of a page or of an
instance.  Occurrences of one token in different slots are different roles, with
vectors and classes of their own.  Classes are found again over roles until a
round finds no further member, or for ``ROUNDS`` rounds; the last round's are the
host's template.  Rounds after the first read only tokens on enough pages, as no
role is on more pages than its token.  A page with a token of the template out of place does not use
it.  All other tokens are data of the slot they stand in.

*Extraction.*  A template token's role is counted over the pages that hold it,
from the elements really open there: the slot after it is content if it lies
inside an article or main element.  A page's own article elements begin and end
content too, and a token that stands outside the article on most pages does not
end one that is open on a page whose article elements are balanced.  A page
without content slot or article element is read whole but for the texts that
are template tokens.  Text inside navigation, header, footer, aside, form, script,
style or title elements, or elements whose class, id or role names such a part, is
never content.  The text of the content slots, block by block, is the page's text.
A page with no text in them, or whose order disagrees with the template, is read by
its own article element, or else whole, under the same names.

Pages are parsed twice, for their tokens and for their text.  Work per page is
linear (an order's longest run: n log n); per host only role summaries and
distinct orders travel, folded in the tasks first, so a host with a third of all
pages is only a few rows per task.  Templates hold outer tokens and are joined to
pages by host, a hot host being dealt over ``SALTS`` keys.

Edge cases: NULL or empty html has empty text; a page cut off inside a tag or
element ends there; text without any template keeps its role by its own
markup; NULL or odd urls fall into the pool; repeated rows are extracted each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospect.session import materialize

MIN_PAGES = 3
SUPPORT = 0.6
SALTS = 32
#: Rounds of telling roles apart, at most.
ROUNDS = 4
#: Summaries a task holds before it hands them on.
_FLUSH = 200_000

# Fixed values of HTML: element kinds.
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "select", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
          "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
CONTENT = {"article", "main"}
NOT_CONTENT = {"nav", "header", "footer", "aside", "form", "head", "button", "menu", "dialog", "title"} | (RAW - {"title"})
#: Parts of class, id or role names that mark what is not the article.
NOT_CONTENT_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies",
    "disclaimer", "footer", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "notices", "pagination", "popup", "promo", "related", "replies", "reply", "search", "share", "sharing", "sidebar", "signup", "social",
    "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)"
    r"|[^<]+|<", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def _element_names(attrs: str) -> str:
    found = {a.lower(): (b or c or d).lower() for a, b, c, d in _NAMES.findall(attrs)}
    return " ".join(f"{k}={found[k]}" for k in sorted(found))


def parse(page: str | None) -> list[tuple[str, str, str]]:
    """(kind, name, value) events: ``open`` (value: class, id and role),
    ``close`` and ``text``.  Raw elements are skipped with their content."""
    out = []
    page = page or ""
    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        s = m.group()
        name = m.group(2) or m.group(5)
        if name:
            name = name.lower()
            closing = m.group(1) or m.group(4)
            attrs = m.group(3) or m.group(6) or ""
            if not s.endswith(">"):
                break  # cut off inside a tag
            if closing:
                out.append(("close", name, ""))
                continue
            out.append(("open", name, _element_names(attrs) if "=" in attrs else ""))
            if name in RAW and not attrs.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.start() if end else size
        elif s[0] != "<" or s == "<":
            out.append(("text", "", s))
    return out


def unwanted(name: str, names: str) -> bool:
    """Whether an element's kind or names mark it as not the article."""
    return name in NOT_CONTENT or bool(names and name not in ("html", "body", "article", "main")
                                       and not NOT_CONTENT_NAMES.isdisjoint(_WORD.findall(names)))


def tokens(events: list[tuple[str, str, str]]) -> list[int | None]:
    """A token for each event, as an even hash: tags and text runs with the
    structural elements around them; None for white space."""
    path: list[str] = []
    around = ""
    digest = xxhash.xxh64_intdigest
    out: list[int | None] = []
    for kind, name, value in events:
        if kind == "text":
            run = " ".join(value.split())
            out.append(digest(f"{around}|{run}") >> 2 << 1 if run else None)
            continue
        structural = name not in INLINE and name not in VOID and name != "p"
        if kind == "close":
            if structural and name in path:
                while path and path.pop() != name:
                    pass
                around = "/".join(path[-3:])
            out.append(digest(f"{around}</{name}>") >> 2 << 1)
        else:
            out.append(digest(f"{around}<{name} {value}>") >> 2 << 1)
            if structural:
                path.append(name)
                around = "/".join(path[-3:])
    return out


class Ancestors:
    """Open elements of a page while its events are read: whether an unwanted
    element is open, and how many article or main elements outside those."""

    def __init__(self):
        self.skip: list[str] = []   # open elements below an unwanted one
        self.own = 0

    def read(self, kind: str, name: str, value: str) -> None:
        if kind == "open":
            if name not in VOID:
                if self.skip:
                    if name == self.skip[0]:
                        self.skip.append(name)
                elif unwanted(name, value):
                    self.skip.append(name)
                elif name in CONTENT:
                    self.own += 1
        elif kind == "close":
            if self.skip:
                if name == self.skip[-1]:
                    self.skip.pop()
            elif name in CONTENT and self.own:
                self.own -= 1


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "")
    return m.group(1).lower() if m else ""


# ------------------------------------------------------------------ template

def _keyed(pages: DataFrame) -> DataFrame:
    """Pages with their template key: the host, or '' for the pool."""
    host = F.lower(F.coalesce(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    return pages.select(F.col("page_id"), F.col("url"), F.col("html"), host.alias("host"))


def _mix(role: int, slot: int) -> int:
    """Role of a token of ``role`` inside ``slot`` (integers hash alike in every process)."""
    return hash((role, slot)) >> 2 << 1


def page_tokens(pages: DataFrame) -> DataFrame:
    """(host, key, seq array<long>): the tokens of every page as hashes, in its
    order; the lowest bit tells whether the page is inside an article after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out = []
                for source in part.column(1):
                    events, at, seq = parse(source.as_py()), Ancestors(), []
                    for event, t in zip(events, tokens(events)):
                        at.read(*event)
                        if t is not None:
                            seq.append(t | (at.own > 0))
                    out.append(seq)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(out, pa.list_(pa.int64()))], names=["host", "key", "seq"])

    key = F.xxhash64("page_id", "url", F.length("html"))
    return pages.select("host", "html", key.alias("key")).mapInArrow(run, "host string, key long, seq array<long>")


class Level:
    """Valid classes of one round.  ``rank``: place of each token found once a
    page.  ``ring``: class, and whether it ends an instance, of each token of the
    classes found several times.  ``content``: whether the slot after a token is."""

    def __init__(self, members: list[dict]):
        self.rank, self.ring, self.content = {}, {}, {}
        last: dict[int, int] = {}
        for m in members:  # by class and rank
            self.content[m["role"]] = m["content"]
            if m["class"]:
                last[m["class"]] = m["role"]
            else:
                self.rank[m["role"]] = len(self.rank)
        for m in members:
            if m["class"]:
                self.ring[m["role"]] = m["class"], last[m["class"]] == m["role"]

    def roles(self, seq: list[int]) -> list[int]:
        """Roles of a page's tokens: a token found once a page keeps its own, any
        other is told apart by the slot, or the place in an open instance, it
        stands in."""
        rank, ring = self.rank, self.ring
        if not rank and not ring:
            return seq
        out, slot = [], 0
        within: list[tuple[int, int]] = []  # open instances: class, slot
        opened: set[int] = set()
        for x in seq:
            if x in rank:
                slot = x
                within.clear()
                opened.clear()
            elif x in ring:
                c, ends = ring[x]
                while c in opened:
                    opened.discard(within.pop()[0])
                x = _mix(x, within[-1][1] if within else slot)
                if not ends:
                    within.append((c, x))
                    opened.add(c)
            else:
                x = _mix(x, within[-1][1] if within else slot)
            out.append(x)
        return out


class _ByHost(dict):
    """Values of a task's recent hosts, each made once."""

    def of(self, host: str, make: Callable[[], object]):
        if host not in self:
            if len(self) >= 1000:
                self.clear()
            self[host] = make()
        return self[host]


def _levels(value: pa.Scalar) -> list[Level]:
    return [Level(m) for m in value.as_py() or []]


def occurrence_summaries(seqs: DataFrame, levels: DataFrame | None) -> DataFrame:
    """(host, role, times, pages, vector, inside): per host and role its pages,
    the hash of its occurrence vector, the largest number of occurrences, and the
    number of pages on which it is inside an article after its first occurrence.
    With ``levels`` (host, levels, frequent) only ``frequent`` tokens are read: the
    roles of any other are on too few pages as well."""
    leveled = levels is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}
        known = _ByHost()

        def out():
            keys, vals = list(held.keys()), list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int64())] + [pa.array([v[i] for v in vals], pa.int64()) for i in range(5)],
                names=["host", "role", "times", "pages", "low", "high", "inside"])

        for batch in batches:
            hosts, keys, seqs_ = (batch.column(i).to_pylist() for i in range(3))
            for i, (host, key, marked) in enumerate(zip(hosts, keys, seqs_)):
                if leveled:
                    levels, frequent = known.of(host, lambda: (_levels(batch.column(3)[i]), frozenset(batch.column(4)[i].as_py() or ())))
                    marked = [x for x in marked if x & -2 in frequent]
                seq = [x & -2 for x in marked]
                if leveled:
                    for level in levels:
                        seq = level.roles(seq)
                seen: dict[int, int] = {}
                inside = []
                for x, m in zip(seq, marked):
                    if x in seen:
                        seen[x] += 1
                    else:
                        seen[x] = 1
                        if m & 1:
                            inside.append(x)
                bits = {n: hash((key, n)) for n in set(seen.values())}
                for x, n in seen.items():
                    v = held.get((host, x))
                    if v is None:
                        held[host, x] = [n, 1, bits[n] & 0xFFFFFFFF, bits[n] >> 32 & 0xFFFFFFFF, 0]
                    else:
                        if n > v[0]:
                            v[0] = n
                        v[1] += 1
                        v[2] += bits[n] & 0xFFFFFFFF
                        v[3] += bits[n] >> 32 & 0xFFFFFFFF
                for x in inside:
                    held[host, x][4] += 1
            if len(held) > _FLUSH:
                yield out()
        if held:
            yield out()

    rows = _salted(seqs, levels, "key").select("host", "key", "seq", "levels", "frequent") if leveled else seqs
    rows = rows.mapInArrow(
        run, "host string, role long, times long, pages long, low long, high long, inside long")
    # Sums, not exclusive ors: a page that occurs twice must not cancel itself.
    return rows.groupBy("host", "role").agg(
        F.max("times").alias("times"), F.sum("pages").alias("pages"), F.xxhash64(F.sum("low"), F.sum("high")).alias("vector"),
        F.sum("inside").alias("inside"))


def _salted(rows: DataFrame, by_host: DataFrame, *key: str) -> DataFrame:
    """``rows`` with the columns of their host's row, a hot host being dealt over
    ``SALTS`` keys."""
    dealt = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int")).join(dealt, ["host", "salt"], "left").drop("salt")


def instance_orders(seq: list[int], place: dict[int, int], classes: list[int], sizes: dict[int, int], pages: dict[int, int], fixed: dict) -> dict[int, tuple]:
    """Order, as places, of each class found several times on a page, for those
    whose instances hold every token once in one order and nest: no template
    token of the round before (``fixed``) stands inside one, and where two classes
    cross, the one on fewer pages is out."""
    within: list[tuple[int, list[int]]] = []
    depth: dict[int, int] = {}
    order: dict[int, tuple] = {}
    out: set[int] = set()
    for x in seq:
        if x in fixed:
            out.update(depth)
            within.clear()
            depth.clear()
            continue
        p = place.get(x)
        c = classes[p] if p is not None else 0
        if not c:
            continue
        if c in depth:
            while len(within) > depth[c] + 1:
                other = within.pop()[0]
                del depth[other]
                out.add(other if (pages[other], other) < (pages[c], c) else c)
        else:
            depth[c] = len(within)
            within.append((c, []))
        held = within[-1][1]
        held.append(p)
        if len(held) == sizes[c]:
            within.pop()
            del depth[c]
            if order.setdefault(c, tuple(held)) != tuple(held) or len(set(held)) < len(held):
                out.add(c)
    out.update(depth)
    return {c: o for c, o in order.items() if c not in out}


def page_orders(seqs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(host, class, seq array<int>, n): the distinct orders in which pages hold
    the ``candidates`` (host, names, classes, counts, levels, frequent) of their host, as
    places in ``names``, and their number of pages.  Class 0 stands for all tokens found
    once a page, any other for an instance of that class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, tuple[int, ...]], int] = {}
        known = _ByHost()
        size = 0

        def out():
            batch = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in held]), pa.array([k[1] for k in held], pa.int32()), pa.array([k[2] for k in held], pa.list_(pa.int32())),
                 pa.array(list(held.values()), pa.int64())], names=["host", "class", "seq", "n"])
            held.clear()
            return batch

        def read(names, classes, counts, levels, frequent):
            classes = classes.as_py()
            return ({t: k for k, t in enumerate(names.as_py())}, classes, Counter(classes), dict(zip(classes, counts.as_py())),
                    _levels(levels), frozenset(frequent.as_py() or ()))

        for batch in batches:
            hosts, seqs_ = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, host in enumerate(hosts):
                place, classes, sizes, counts, levels, frequent = known.of(host, lambda: read(*(c[i] for c in batch.columns[2:])))
                seq = [x & -2 for x in seqs_[i]]
                if levels:
                    seq = [x for x in seq if x in frequent]
                for level in levels:
                    seq = level.roles(seq)
                orders = {}
                if len(sizes) > (0 in sizes):
                    orders = instance_orders(seq, place, classes, sizes, counts, levels[-1].rank if levels else {})
                orders[0] = tuple(p for p in map(place.get, seq) if p is not None and not classes[p])
                for c, o in orders.items():
                    if o:
                        k = host, c, o
                        size += k not in held and len(o)
                        held[k] = held.get(k, 0) + 1
            if size > _FLUSH:
                yield out()
                size = 0
        if held:
            yield out()

    rows = _salted(seqs, candidates, "key").filter("names IS NOT NULL").select("host", "seq", "names", "classes", "counts", "levels", "frequent")
    return rows.mapInArrow(run, "host string, class int, seq array<int>, n long").groupBy("host", "class", "seq").agg(F.sum("n").alias("n"))


def longest_run(ranks: list[int]) -> list[int]:
    """A longest rising subsequence of distinct ranks."""
    ends: list[int] = []     # smallest last rank of the runs of each length
    at: list[int] = []       # its place
    before: list[int] = []
    for i, r in enumerate(ranks):
        k = bisect_left(ends, r)
        before.append(at[k - 1] if k else -1)
        ends[k:k + 1], at[k:k + 1] = [r], [i]
    run, i = [], at[-1] if at else -1
    while i >= 0:
        run.append(ranks[i])
        i = before[i]
    return run[::-1]


def tokens_in_place(orders: DataFrame) -> DataFrame:
    """(host, place, rank, kept): for each token of the most frequent order of
    a host its rank there and the number of pages that hold it in that order."""
    best = materialize(orders.groupBy("host").agg(F.max(F.struct("n", F.xxhash64("seq").alias("h"), "seq")).alias("b")).select(
        "host", F.col("b.seq").alias("best")), "html-orders-best")
    dealt = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = orders.withColumn("salt", F.pmod(F.xxhash64("seq"), F.lit(SALTS)).cast("int")).join(dealt, ["host", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[str, int, int], int] = {}

        def out():
            keys = list(kept)
            batch = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys]), *[pa.array([k[j] for k in keys], pa.int32()) for j in (1, 2)], pa.array(list(kept.values()), pa.int64())],
                names=["host", "place", "rank", "kept"])
            kept.clear()
            return batch

        for batch in batches:
            for host, seq, n, order in zip(*(c.to_pylist() for c in batch.columns)):
                rank = {p: r for r, p in enumerate(order)}
                for r in longest_run([rank[p] for p in seq if p in rank]):
                    kept[host, order[r], r] = kept.get((host, order[r], r), 0) + n
            if len(kept) > _FLUSH:
                yield out()
        if kept:
            yield out()

    rows = both.select("host", "seq", "n", "best").mapInArrow(run, "host string, place int, rank int, kept long")
    return rows.groupBy("host", "place", "rank").agg(F.sum("kept").alias("kept"))


def frequent_roles(seqs: DataFrame, sizes: DataFrame, levels: DataFrame | None) -> DataFrame:
    """Summaries of the roles on enough of their host's pages, and how many are."""
    enough = F.greatest(F.lit(MIN_PAGES), F.ceil(F.col("all_pages") * SUPPORT))
    return occurrence_summaries(seqs, levels).join(sizes, "host").withColumn("enough", enough).filter(F.col("pages") >= F.col("enough"))


def deduce_classes(seqs: DataFrame, found: DataFrame, levels: DataFrame | None) -> DataFrame:
    """(host, members array<struct<class, rank, role, content>>): the valid classes
    of one round, in order; class 0 holds the tokens found once a page.

    Equivalence classes are the roles of equal (pages, vector) among those
    ``found`` on enough of the host's pages."""
    # Without slots, tokens found several times a page are not told apart yet.
    found = found if levels is not None else found.filter("times = 1")
    # A class of one token says nothing about order; two or more do.
    several = F.size("members") >= 2
    grouped = ["host", "pages", "vector", "enough"]
    member = F.struct("role", (F.col("inside") * 2 > F.col("pages")).alias("content"), "times")
    classes = found.groupBy(*grouped).agg(F.collect_list(member).alias("members")).filter(several)
    # A host's candidates in one array; a token's place in it names the token.
    one = F.struct(F.col("m.role").alias("role"), F.col("m.content").alias("content"), "pages", "vector", "enough", (F.col("m.times") == 1).alias("once"))
    candidates = classes.select(*grouped, F.explode("members").alias("m")).groupBy("host").agg(F.sort_array(F.collect_list(one)).alias("c"))
    # Classes found several times are numbered from 1 by their vectors.
    vectors = F.array_sort(F.array_distinct(F.transform(F.filter("c", lambda m: ~m["once"]), lambda m: m["vector"])))
    candidates = candidates.withColumn("v", vectors)
    number = F.transform("c", lambda m: F.when(m["once"], 0).otherwise(F.array_position(F.col("v"), m["vector"]).cast("int")))
    candidates = materialize(candidates.select("host", "c", number.alias("classes")), "html-candidates")
    sent = candidates.select("host", F.col("c.role").alias("names"), "classes", F.col("c.pages").alias("counts"))
    if levels is None:
        sent = sent.withColumns({"levels": F.lit(None).cast(f"array<{_MEMBERS}>"), "frequent": F.lit(None).cast("array<long>")})
    else:
        sent = sent.join(levels, "host", "left")
    orders = materialize(page_orders(seqs, sent), "html-orders")
    placed = tokens_in_place(orders.filter("class = 0").drop("class")).join(candidates, "host").select(
        "host", "rank", "kept", F.col("c")[F.col("place")].alias("m")).select("host", "rank", "kept", "m.*")
    valid = placed.filter("kept >= enough").groupBy("host", "pages", "vector").agg(
        F.collect_list(F.struct(F.lit(0).alias("class"), "rank", "role", "content")).alias("members"))
    flat = valid.filter(several).select("host", F.explode("members").alias("m"))
    if levels is not None:
        ring = orders.filter("class > 0").groupBy("host", "class").agg(F.max(F.struct("n", "seq")).alias("b")).join(candidates, "host")
        ring = ring.select("host", "class", F.col("b.n").alias("n"), "c", F.posexplode("b.seq").alias("rank", "place"))
        ring = ring.select("host", "class", "n", "rank", F.col("c")[F.col("place")].alias("m")).filter("n >= m.enough")
        flat = flat.unionByName(ring.select("host", F.struct("class", "rank", "m.role", "m.content").alias("m")))
    return flat.groupBy("host").agg(F.sort_array(F.collect_list("m")).alias("members"))


_MEMBERS = "array<struct<class:int,rank:int,role:bigint,content:boolean>>"


def deduce_templates(pages: DataFrame, sizes: DataFrame) -> DataFrame:
    """(host, levels array<array<struct<class, rank, role, content>>>): the valid
    classes of each round; the last is the host's template, those before tell
    the roles of its tokens apart.  Rounds end when none finds another class
    member, or after ``ROUNDS``."""
    seqs = materialize(page_tokens(pages), "html-tokens")
    levels, before = None, -1
    none = F.array().cast(_MEMBERS)
    for _ in range(ROUNDS):
        found = frequent_roles(seqs, sizes, levels)
        if levels is None:
            found = materialize(found, "html-roles")
        last = F.array(F.coalesce("members", none)).alias("levels")
        members = deduce_classes(seqs, found, levels)
        if levels is None:
            hosts = found.groupBy("host").agg(F.collect_list("role").alias("frequent"))
            levels = hosts.join(members, "host", "left").select("host", last, "frequent")
        else:
            levels = levels.join(members, "host", "left").select("host", F.concat("levels", last).alias("levels"), "frequent")
        levels = materialize(levels, "html-levels")
        held = levels.agg(F.sum(F.size(F.element_at("levels", -1)))).first()[0] or 0
        if held == before:
            break
        before = held
    return levels.drop("frequent")


def extract(page: str | None, levels: list[Level]) -> str:
    """Main text of a page: blocks of its content slots joined by newlines."""
    events = parse(page)
    if not events:
        return ""
    if levels:
        own = tokens(events)
        seq = [t for t in own if t is not None]
        for level in levels[:-1]:
            seq = level.roles(seq)
        last = levels[-1]
        ranks = [last.rank[x] for x in seq if x in last.rank]
        if ranks and all(a < b for a, b in zip(ranks, ranks[1:])):
            each = iter(seq)
            text = _read(events, [None if t is None else next(each) for t in own], last.content)
            if text:
                return text
    return _read(events, [None] * len(events), {})


def _read(events: list[tuple[str, str, str]], roles: list[int | None], content: dict[int, bool]) -> str:
    """Text of the content slots; without any, of the page's own article
    elements, or else of the whole page but what the template repeats."""
    opened = sum(k == "open" and n in CONTENT for k, n, _ in events)
    balanced = opened == sum(k == "close" and n in CONTENT for k, n, _ in events)
    slots = any(content.get(r, False) for r in roles)
    whole = not slots and not opened
    in_content = whole
    blocks: list[str] = []
    block: list[str] = []
    at = Ancestors()

    def flush():
        text = _SPACE.sub(" ", _html.unescape("".join(block))).strip()
        block.clear()
        if text:
            blocks.append(text)

    for (kind, name, value), role in zip(events, roles):
        if kind != "text":
            if name not in INLINE:
                flush()
            own = at.own
            at.read(kind, name, value)
            if bool(own) != bool(at.own):
                in_content = at.own > 0
        if slots and role in content:
            if content[role]:
                in_content = True
            elif not (at.own and balanced):
                in_content = False
        if kind == "text" and not at.skip and in_content and not (whole and role in content):
            block.append(value)
    flush()
    return "\n".join(blocks)


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    keyed = _keyed(pages)
    counted = materialize(keyed.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "html-hosts")
    pool = F.when(F.col("n") < MIN_PAGES, F.lit("")).otherwise(F.col("host"))
    sizes = counted.groupBy(pool.alias("host")).agg(F.sum("n").alias("all_pages"))
    small = counted.filter(F.col("n") < MIN_PAGES).select("host", F.lit("").alias("pool"))
    pooled = keyed.join(small, "host", "left").withColumn("host", F.coalesce("pool", "host")).drop("pool")
    levels = deduce_templates(pooled, sizes)
    ready = _salted(pooled, levels, "page_id", "url").select("page_id", "url", "html", "host", "levels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _ByHost()
        for batch in batches:
            hosts = batch.column(3).to_pylist()
            texts = [extract(h.as_py(), known.of(host, lambda t=t: _levels(t))) for h, host, t in zip(batch.column(2), hosts, batch.column(4))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return ready.mapInArrow(run, "page_id long, url string, text string, n_chars long")
