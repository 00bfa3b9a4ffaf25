"""HTML extraction by wrapper induction.

Pages of one host are aligned with a reference page of that host (the one with the smallest hash of its id) by simple
tree matching; pages that match it poorly are grouped by layout and aligned with a reference of their own. Every text
block gets the place in the reference where it stands: the text node that it is aligned with, or the nearest aligned element
around it. Over all pages of the layout it is summed

* which slots are filled alike by at least CONSTANT of at least LEAST pages: that text is template;
* how many characters vary at each place: the wrapper's content region is found from the root down, into the one child
  that holds over half of what varies, for as long as there is such a container; headings before it belong to it.

A page's text is what stands in the region and is not template. What the alignment cannot tell is left to marks, that is to
tags, classes, ids and roles: inside the region, elements that are marked as menus, adverts, forms, comments and the like
are left out (two pages' comments vary as their articles do); and pages of hosts or layouts with fewer than LEAST pages, and
pages with nothing in the region, keep what is in their article or main element, or else all that is not marked. decided_by says which it was.

Null html gives an empty text; pages without a host have no template. Malformed, deeply nested, wide and very long pages
are read whole; the reference is a page of at most REFERENCE characters where the host has one, else the shortest. Repeated pages are rows of their own; a host of
nothing but equal pages has no region, and where a page would lose all of its text to the template it keeps it.
Empty tables give empty results. Columns other than those named are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, stash
from .dom import Node, match, parse, preorder
from .url_rules import host_path

CONSTANT, LEAST, ALIKE, MAJOR = 0.8, 5, 0.5, 0.5
#: Characters of a reference page that is broadcast, if the host has over one in PARTS of all pages.
REFERENCE, PARTS = 1 << 17, 500
#: Elements of running text: never the container of an article.
RUNNING = frozenset("p ul ol dl li dt dd blockquote pre figure h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3".split())


def leaves(root: Node) -> list[Node]:
    return [n for n in preorder(root) if n.tag == "#text"]


def content_leaves(root: Node) -> list[Node]:
    """Text blocks that may be article text by their marks, in page order."""
    for tag in ("article", "main"):
        texts, todo = [], [(root, False)]
        while todo:
            n, inside = todo.pop()
            if n.apart:
                continue
            inside = inside or n.tag == tag
            if inside and n.tag == "#text":
                texts.append(n)
            todo.extend((k, inside) for k in reversed(n.kids))
        if texts:
            return texts
    return [t for t in leaves(root) if not t.apart]


class Reference:
    def __init__(self, page: str):
        self.root = parse(page)
        self.nodes = preorder(self.root)
        self.place = {id(n): k for k, n in enumerate(self.nodes)}
        self.texts = sum(n.tag == "#text" for n in self.nodes)

    def region(self, varying: dict[int, int]) -> tuple[int, int] | None:
        """Places of the content region, from the characters that vary at each place."""
        before = [0]
        for k in range(len(self.nodes)):
            before.append(before[-1] + varying.get(k, 0))
        mass = lambda n: before[self.place[id(n)] + n.size] - before[self.place[id(n)]]
        here, above = self.root, []
        if mass(here) <= 0:
            return None
        while major := next((k for k in here.kids if k.kids and k.size > 2 and k.tag not in RUNNING and mass(k) > MAJOR * mass(here)), None):
            above.append(here)
            here = major
        start, end, below = self.place[id(here)], self.place[id(here)] + here.size, here
        for n in reversed(above[1:]):
            heads = [k for k in n.kids[: next(i for i, k in enumerate(n.kids) if k is below)] if k.tag in HEADINGS]
            start, below = min([start, *(self.place[id(k)] for k in heads)]), n
        return start, end


def page_blocks(page: str | None, reference: Reference | None, marks: bool = True) -> tuple[list[dict], int]:
    """The page's text blocks, and its layout: 0 where it has the reference's, else a number made of its outermost elements.

    A block: text, its hash h, place (-1: none), slot (whether a text of the reference is there), main (whether it may be
    article text by its marks), apart (whether it is marked as something else).
    """
    root = parse(page or "")
    nodes = preorder(root)
    place: dict[int, int] = {}
    slots = 0
    if reference:
        pairs: list[tuple[Node, Node]] = []
        match(reference.root, root, pairs)
        place = {id(b): reference.place[id(a)] for a, b in pairs}
        slots = sum(b.tag == "#text" for _, b in pairs)
    main = {id(n) for n in content_leaves(root)} if marks else None
    at, out = {id(root): place.get(id(root), -1)}, []
    for n in nodes:
        for k in n.kids:
            at[id(k)] = place.get(id(k), at[id(n)])
        if n.tag == "#text":
            out.append({"text": n.text, "h": xxhash.xxh3_64_intdigest(n.text) >> 1, "place": at[id(n)], "slot": id(n) in place, "main": main is None or id(n) in main, "apart": marks and n.apart})
    alike = not reference or slots >= ALIKE * min(len(out), reference.texts)
    names = sorted({k.tag for k in root.kids} | {f"{k.tag}/{x.tag}" for k in root.kids for x in k.kids})
    return out, 0 if alike else (xxhash.xxh3_64_intdigest("|".join(names)) >> 1) or 1


_BLOCK = pa.struct([("text", pa.string()), ("h", pa.int64()), ("place", pa.int32()), ("slot", pa.bool_()), ("main", pa.bool_()), ("apart", pa.bool_())])
_BLOCKS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("layout", pa.int64()), ("html", pa.string()), ("blocks", pa.list_(_BLOCK))])
_BLOCKS_DDL = "page_id long, url string, host string, layout long, html string, blocks array<struct<text:string,h:long,place:int,slot:boolean,main:boolean,apart:boolean>>"


def _blocks(rows: DataFrame, marks: bool) -> DataFrame:
    """rows: page_id, url, html, host, layout, ref. Where layout is null it is found out; html stays for pages of another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, Reference | None] = {}
        for b in batches:
            for at in range(0, b.num_rows, 200):
                out = []
                for page_id, url, page, host, layout, ref in zip(*(c.to_pylist() for c in b.slice(at, 200).columns), strict=True):
                    if (key := (host, layout)) not in known:
                        if len(known) > 500:
                            known.clear()
                        known[key] = Reference(ref) if ref else None
                    found, own = page_blocks(page, known[key], marks)
                    own = own if layout is None else layout
                    out.append((page_id, url, host, own, page if layout is None and own else None, found))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _BLOCKS, strict=True)], schema=_BLOCKS)

    return rows.select(F.col("page_id").cast("long"), "url", "html", "host", "layout", "ref").mapInArrow(run, _BLOCKS_DDL)


def _references(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each key: c, its pages, and ref, the html of one of them."""
    over = F.greatest(F.length("html") - REFERENCE, F.lit(0)).alias("over")
    return rows.groupBy(*keys).agg(F.count("*").alias("c"), F.min_by("html", F.struct(over, F.xxhash64("page_id"), "page_id", F.xxhash64("html"))).alias("ref"))


def _with_references(rows: DataFrame, refs: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Pages with their reference. Those of hosts with many pages are broadcast, or if long, repeated for as many salts as the host has parts."""
    total = refs.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    many = F.col("c") * PARTS > total
    near = refs.where(many & (F.length("ref") <= REFERENCE))
    far = refs.where(~(many & (F.length("ref") <= REFERENCE))).withColumn("_salts", F.when(many, F.ceil(F.col("c") * PARTS / max(1, total))).otherwise(1).cast("int"))
    salts = far.where("_salts > 1").select(*on, "_salts")  # fewer than PARTS rows of numbers
    rest = rows.join(F.broadcast(near.select(*on)), on, "left_anti").join(F.broadcast(salts), on, "left")
    rest = rest.withColumn("_salt", F.pmod(F.xxhash64("page_id", "html"), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    far = far.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return rows.join(F.broadcast(near), on).unionByName(rest.join(far, [*on, "_salt"], how).drop("_salt")).drop("c")


_RULES = pa.schema([("host", pa.string()), ("layout", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def _regions(rows: DataFrame) -> DataFrame:
    """rows: host, layout, ref, varying (array of place, chars). The content region of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for host, layout, ref, varying in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = Reference(ref).region({v["place"]: v["chars"] for v in varying})
                out.append((host, layout, *(found or (None, None))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _RULES, strict=True)], schema=_RULES)

    return rows.select("host", "layout", "ref", "varying").mapInArrow(run, "host string, layout long, start int, end int")


def _wrappers(blocks: DataFrame, refs: DataFrame) -> DataFrame:
    """For each host and layout with enough pages: c (pages), start and end of its region, fixed (place, h of its template)."""
    filled = blocks.where("host <> ''").select("host", "layout", F.explode(F.transform("blocks", lambda b: F.struct(b["place"].alias("place"), b["slot"].alias("slot"), F.when(b["slot"], b["h"]).alias("h"), F.length(b["text"]).alias("n")))).alias("b")).select("host", "layout", "b.*").where("place >= 0")
    cells = filled.groupBy("host", "layout", "place", "slot", "h").agg(F.count("*").alias("c"), F.sum("n").alias("m"))
    per = cells.groupBy("host", "layout", "place", "slot").agg(F.sum("c").alias("n"), F.sum("m").alias("m"), F.max(F.struct("c", "h", "m")).alias("most"))
    fixed = F.col("slot") & (F.col("n") >= LEAST) & (F.col("most.c") >= CONSTANT * F.col("n"))
    per = per.withColumns({"fixed": F.when(fixed, F.struct("place", F.col("most.h").alias("h"))), "chars": F.col("m") - F.when(fixed, F.col("most.m")).otherwise(0)})
    sums = per.groupBy("host", "layout", "place").agg(F.sum("chars").alias("chars"), F.max("fixed").alias("fixed"))
    packed = sums.groupBy("host", "layout").agg(F.collect_list(F.struct("place", "chars")).alias("varying"), F.collect_list("fixed").alias("fixed"))
    pages = blocks.groupBy("host", "layout").agg(F.count("*").alias("c")).where(F.col("c") >= LEAST)
    packed = stash(packed.join(pages, ["host", "layout"]).join(refs.select("host", "layout", "ref"), ["host", "layout"]), "wrappers")
    return packed.drop("varying", "ref").join(stash(_regions(packed), "regions"), ["host", "layout"])


def extract(pages: DataFrame, marks: bool = True) -> DataFrame:
    """pages: page_id, url, html. One row per page: page_id, url, text, n_chars, decided_by.

    marks: False leaves tags, classes, ids and roles out of account, so that the alignment alone decides.
    """
    host = host_path(F.col("url"))[0]
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    none = F.lit(None).cast("long").alias("layout")
    refs = stash(_references(rows.where("host <> '' and html is not null"), ["host"]), "references")
    joined = _with_references(rows.where("host <> ''"), refs, ["host"], "left").unionByName(rows.where("host = ''"), allowMissingColumns=True)
    blocks = stash(_blocks(joined.select("*", none), marks), "blocks")
    # pages of other layouts
    odd = blocks.where("layout <> 0")
    more = stash(_references(odd, ["host", "layout"]).where(F.col("c") >= LEAST), "layout-references")
    own = stash(_blocks(_with_references(odd.drop("blocks"), more, ["host", "layout"]), marks), "layout-blocks").drop("html")
    # pages whose layout too few share stay with the host's reference
    kept = join_counted(blocks.drop("html"), more.drop("ref").withColumn("_own", F.lit(True)), ["host", "layout"], "left").where("_own is null").drop("_own", "c").withColumn("layout", F.lit(0).cast("long"))
    blocks = kept.unionByName(own)
    rules = stash(_wrappers(blocks, refs.withColumn("layout", F.lit(0).cast("long")).unionByName(more)), "rules")
    full = join_counted(blocks, rules, ["host", "layout"], "left")
    new = lambda b: ~F.coalesce(F.array_contains("fixed", F.struct(b["place"].alias("place"), b["h"].alias("h"))), F.lit(False))
    inside = F.filter("blocks", lambda b: new(b) & ~b["apart"] & F.coalesce((b["place"] >= F.col("start")) & (b["place"] < F.col("end")), F.lit(False)))
    marked = F.filter("blocks", lambda b: b["main"])
    full = full.withColumns({"_in": inside, "_marked": marked, "_new": F.filter("blocks", lambda b: b["main"] & new(b))})
    some = lambda c: F.size(c) > 0
    best: Column = F.when(some("_in"), F.col("_in")).when(some("_new"), F.col("_new")).otherwise(F.col("_marked"))
    text = F.array_join(F.transform(best, lambda b: b["text"]), "\n\n")
    return full.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), F.when(some("_in"), "alignment").otherwise("marks").alias("decided_by"))
