"""N-gram Jaccard self-join with adaptive multi-match prefixes, and the components of its links.

Two documents link when the Jaccard similarity of their sets of five-word shingles is at least THRESHOLD percent.

1. Equal sets become one (a 128-bit digest of the sorted 64-bit shingle hashes stands for a set).
2. Shingles are ordered alike in all sets, by hash. If two sets link, their prefixes of n - ceil(t n) + l shingles share
   at least l of these, for any l up to ceil(t n). Each set posts the longest prefix that may be asked for.
3. Sets that have too few posted shingles in common with any others to link at all drop out.
4. Each set picks its l, and with it how far its prefix reaches, by the estimated cost of its candidates. Each shingle's list of
   sets is joined with one leader of the list; pairs that share the l of the larger set in their prefixes are verified, and
   links are merged, in a few rounds with other leaders. A list whose sets are all in one component needs no more work, so a group
   of near copies costs a row for each of its sets, not for each pair.
5. All pairs of different components that are left in some list are joined. Here each set picks its l anew, by the lengths of
   whole lists and verifications at 1 / l of their pairs.
   With h shingles of long lists among its prefix, a link shares at least l - h of the others, so long lists are passed
   over by lengthening the prefix. Candidates with enough shared shingles are verified on whole sets. Sets that no l
   frees of long lists (odd members of large families of near copies) are compared with their family block by block.

No list is capped and no link between different components is lost. Null and empty texts have an empty set and link
with nothing; texts under five words are one shingle; ties and repeated rows (also of one id) are rows of their own.
Empty tables give empty results; only doc_id and text are read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, join_small, join_spread, stash, unstash
from .hashing import chunks, mix, span_hashes, words

WIDTH, THRESHOLD = 5, 80
#: The first postings serve an l of up to one more than this share (in percent) of a set's size; the rounds with leaders choose l
#: among the next shares, the last step, on the whole sets that are left, among the last ones.
FIRST, EARLY, CHOICES = 10, (0, 2, 5, 10), (0, 5, 10, 20, 30, 40, 50, 60, 70)
#: Verifying costs as much as so many list entries. Lists of more sets than LONG are passed over where possible. Sets in a
#: block of a family.
VERIFY, LONG, PART = 20, 16, 256
ROUNDS = 4
#: So many row numbers at most are broadcast. A token of over one in HOT entries is counted apart.
KEYS, HOT = 1_000_000, 1000


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    mult = np.array([pow(0xD6E8FEB86659FD93, j, 2**64) for j in range(width)], np.uint64)
    for a, b, data, offsets in chunks(raw):
        s, e = words(data)
        w = span_hashes(data, s, e)
        at = np.searchsorted(s, offsets)
        n = max(0, len(w) - width + 1)
        rolled = np.zeros(n, np.uint64)
        for j in range(width):
            rolled += w[j : j + n] * mult[j]
        rolled = mix(rolled)
        for k in range(b - a):
            lo, hi = at[k], at[k + 1]
            if hi - lo >= width:
                yield np.unique(rolled[lo : hi - width + 1]).view(np.int64)
            elif hi > lo:
                yield mix(np.array([(w[lo:hi] * mult[: hi - lo]).sum() + np.uint64(hi - lo)], np.uint64)).view(np.int64)
            else:
                yield np.zeros(0, np.int64)


def prefix_rows(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """docs: doc_id, text. Each row's rid, doc_id, n, sig, and its longest prefix."""
    kind = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("sig", pa.binary()), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                ids, texts = (c.to_pylist() for c in b.slice(at, 1000).columns)
                out = []
                for i, s in zip(ids, shingle_sets(texts), strict=True):
                    n = len(s)
                    # a larger partner, of up to n / t shingles, may ask for its own l
                    longest = n - (n * threshold + 99) // 100 + 1 + n * FIRST // threshold
                    out.append((part << 33 | row, i, n, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), s[:longest]))
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "rid long, doc_id long, n int, sig binary, tokens array<long>")


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. (node, comp): each node's smallest reachable node. Labels spread to neighbours and jump to their label's label."""
    both = stash(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select("node", "comp"), F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = stash(labels.select("node", "comp").join(near, "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("was")), "labels")
        jump = step.select(F.col("node").alias("comp"), F.col("comp").alias("over"))
        new = stash(step.join(jump, "comp", "left").select("node", F.least("comp", "over").alias("comp"), "was"), "labels")
        unstash(labels, step)
        labels = new
        if not new.where("comp <> was").limit(1).count():
            unstash(both)
            return new.select("node", "comp")


def merge(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """comps (node, comp) with the components that links (a, b) join made one; only joined components are walked."""
    if comps is None:
        return components(links)
    of = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
    pairs = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct().where("a <> b")
    over = components(pairs)
    kept = comps.join(over.select(F.col("node").alias("comp"), F.col("comp").alias("over")), "comp", "left").select("node", F.coalesce("over", "comp").alias("comp"))
    return stash(kept.unionByName(over.join(comps, "node", "left_anti")), "components")


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: rid, doc_id, sig. (rid, set) of these, read again from their texts."""
    kind = pa.schema([("sig", pa.binary()), ("set", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                sets = list(shingle_sets(b.slice(at, 500).column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array(sets, kind[1].type)], schema=kind)

    some = join_small(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), stash(wanted.select("doc_id").distinct(), "wanted"), "doc_id", "left_semi")
    null_ids = docs.where("doc_id is null").select(F.col("doc_id").cast("long"), "text")
    sets = some.union(null_ids).select("text").mapInArrow(run, "sig binary, set array<long>")
    return stash(join_small(sets, stash(wanted.select("rid", "sig"), "wanted"), "sig").dropDuplicates(["rid"]).select("rid", "set"), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """pairs: a, b. Those that link. A set that stands in very many pairs (a family's leader) is repeated for parts of them."""
    pairs = stash(pairs, "pairs")
    one = join_spread(pairs, sets.select(F.col("rid").alias("a"), F.col("set").alias("sa")), "a", F.col("b"), pairs)
    two = join_spread(one, sets.select(F.col("rid").alias("b"), F.col("set").alias("sb")), "b", F.col("a"), pairs)
    both = F.size(F.array_intersect("sa", "sb"))
    return two.where(both * 100 >= threshold * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _alike(a: str, b: str, threshold: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * threshold


def _hot_tokens(posts: DataFrame, total: int) -> DataFrame:
    """(token, df) of tokens in over one of HOT of all entries, so of fewer than HOT tokens, without a shuffle of the others.

    A token with that share of all entries has it in some batch; what has it there is counted over all entries.
    """

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            token, n = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token[n * HOT >= b.num_rows])], names=["token"])

    maybe = stash(posts.select("token").mapInArrow(often, "token long").distinct(), "hot-candidates")
    return stash(join_small(posts.select("token"), maybe, "token", "left_semi").groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") * HOT > total), "hot-tokens")


def postings(rows: DataFrame, copies: DataFrame, threshold: int) -> DataFrame:
    """token, rid, n, e (the l from which on the prefix has this shingle, less 1), df: of sets that may link at all."""
    base = F.col("n") - F.floor((F.col("n") * threshold + 99) / 100)
    total = rows.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    posts = join_small(rows, copies, "rid", "left_anti", KEYS).select("rid", "n", base.alias("base"), F.posexplode("tokens").alias("i", "token"))
    posts = posts.select("token", "rid", "n", F.greatest(F.lit(0), F.col("i") - F.col("base")).cast("int").alias("e"))
    hot = F.broadcast(_hot_tokens(posts, total))  # fewer than HOT tokens
    cold = posts.join(hot.select("token"), "token", "left_anti").withColumn("df", F.count("*").over(Window.partitionBy("token"))).where("df > 1")
    posts = stash(cold.unionByName(posts.join(hot, "token")), "postings")
    unstash(rows)
    for _ in range(2):
        # a link shares the l of its larger set, and that is no less than the smaller set's own
        able = posts.groupBy("rid", "n").agg(F.count("*").alias("c")).where(F.col("c") >= 1 + F.floor(F.col("n") * FIRST / 100))
        able = stash(able.select("rid"), "able")
        some = join_small(posts.drop("df"), able, "rid", "left_semi", KEYS)
        some = stash(_counted(some), "postings")
        unstash(posts, able)
        posts = some
    return posts


def _counted(entries: DataFrame) -> DataFrame:
    """entries with df, the number of entries of their token, where it is over 1."""
    df = stash(entries.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "token-counts")
    return join_counted(entries, df, ["token"], count="df", parts=HOT)


def _lengths(now: DataFrame) -> DataFrame:
    """(rid, l): how many shingles a set's prefix must share in the rounds with leaders, by what each l costs.

    A longer prefix meets the leaders of more lists, but only 1 / l of these meetings can ask for a verification.
    """
    options = [1 + F.floor(F.col("n") * c / 100) for c in EARLY]
    sums = [F.sum(F.when(F.col("e") < l, 1).otherwise(0)).alias(f"s{k}") for k, l in enumerate(options)]
    best = F.array_min(F.array(*[F.struct((F.col(f"s{k}") * (1 + VERIFY / l)).alias("cost"), l.alias("l")) for k, l in enumerate(options)]))
    return now.groupBy("rid", "n").agg(*sums).select("rid", best["l"].cast("int").alias("l"))


def _left(posts: DataFrame, comps: DataFrame | None, sets: DataFrame, threshold: int) -> DataFrame:
    """Entries (as postings, with comp) of the whole sets that may still link with a set of another component."""
    able = _open(posts, comps).groupBy("rid", "n", "comp").agg(F.count("*").alias("c")).where(F.col("c") >= 1 + F.floor(F.col("n") * FIRST / 100))
    base = F.col("n") - F.floor((F.col("n") * threshold + 99) / 100)
    rows = able.join(sets, "rid").select("rid", "n", "comp", base.alias("base"), F.posexplode("set").alias("i", "token"))
    rows = rows.select("token", "rid", "n", "comp", F.greatest(F.lit(0), F.col("i") - F.col("base")).cast("int").alias("e"))
    rows = stash(rows, "left-entries")
    lists = stash(rows.groupBy("token").agg(F.count("*").alias("df"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo <> _hi").select("token", "df"), "left-lists")
    out = stash(join_counted(rows, lists, ["token"], count="df", parts=HOT).select("token", "rid", "n", "comp", "e", "df"), "left")
    unstash(rows, lists)
    return out


def _left_pairs(left: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of different components that share enough prefix shingles, the larger set a choosing how many; and
    the prefixes (rid, token, df) of sets for which no choice passes over the long lists."""
    n, far = F.col("n"), F.col("df") > LONG
    options = [1 + F.floor(n * c / 100) for c in CHOICES]
    sums = []
    for k, l in enumerate(options):
        sums += [F.sum(F.when((F.col("e") < l) & far, 1).otherwise(0)).alias(f"h{k}"), F.sum(F.when((F.col("e") < l) & ~far, F.col("df") - 1).otherwise(0)).alias(f"s{k}")]
    possible = lambda k: (options[k] > F.col(f"h{k}")) & (options[k] * 100 <= n * threshold)
    cost = lambda k: F.when(possible(k), F.col(f"s{k}") * (1 + VERIFY / (options[k] - F.col(f"h{k}"))))
    picks = [F.struct(cost(k).alias("cost"), options[k].alias("l"), (options[k] - F.col(f"h{k}")).alias("need")) for k in range(len(options))]
    best = F.array_min(F.filter(F.array(*picks), lambda p: p["cost"].isNotNull()))
    most = F.when(n > 1, 1 + F.floor(n * FIRST / 100)).otherwise(1)
    chosen = left.groupBy("rid", "n").agg(*sums).select("rid", best.alias("p"), most.alias("most"))
    chosen = chosen.select("rid", F.coalesce("p.l", "most").alias("l"), F.coalesce("p.need", "most").alias("need"), F.col("p").isNull().alias("stuck"))
    x = left.join(chosen, "rid").where("e < l").select("token", F.col("rid").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), "df", "l", "need", "stuck")
    y = left.select("token", F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), "e", "df")
    larger = (F.col("na") > F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") > F.col("b"))
    meet = (F.col("ca") != F.col("cb")) & (F.col("e") < F.col("l")) & larger & _alike("na", "nb", threshold)
    near = x.where((F.col("df") <= LONG) & ~F.col("stuck")).join(y.where(F.col("df") <= LONG).drop("df"), "token").where(meet)
    near = near.groupBy("a", "b", "need").count().where("count >= need").select("a", "b")
    return near, stash(x.where("stuck").select(F.col("a").alias("rid"), "token", "df"), "stuck")


def _dense_links(left: DataFrame, stuck: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links of the sets that are stuck in long lists, block by block.

    Sets that share shingles with stuck ones form families; a family's stuck sets and all its sets are dealt into blocks
    of like size, and each pair of blocks is compared whole by products of 0/1 matrices. Only links are emitted, and of these only as many as join the same components.
    """
    entries = left.join(stuck.select("token").distinct(), "token", "left_semi").select("token", "rid")
    lead = entries.groupBy("token").agg(F.min("rid").alias("lead"))
    leads = stash(entries.join(lead, "token").select("rid", "lead").distinct(), "leads")
    least = leads.groupBy("rid").agg(F.min("lead").alias("least"))
    # leaders that meet in some set are of one family; sets take the family of their least leader
    family = components(leads.join(least, "rid").select(F.col("lead").alias("a"), F.col("least").alias("b")).distinct())
    family = least.join(family, least["least"] == family["node"]).select(F.col("rid").alias("node"), "comp")
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / threshold))).cast("int")
    docs = left.select("rid", "n", "comp").distinct().join(family.select(F.col("node").alias("rid"), F.col("comp").alias("family")), "rid").withColumn("step", step)
    docs = docs.join(stuck.select("rid").distinct().withColumn("stuck", F.lit(True)), "rid", "left").withColumn("stuck", F.coalesce("stuck", F.lit(False)))
    docs = stash(docs, "families")
    # a stuck set meets sets of its own step of size and of the next ones; blocks are counted for each family and step
    seek = docs.where("stuck").withColumn("at", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)))
    many = seek.groupBy("family", "at").agg(F.count("*").alias("s")).join(docs.groupBy("family", F.col("step").alias("at")).agg(F.count("*").alias("c")), ["family", "at"])
    many = stash(many.select("family", "at", F.ceil(F.col("s") / PART).cast("int").alias("i_n"), F.ceil(F.col("c") / PART).cast("int").alias("j_n")), "blocks")
    h = F.xxhash64("rid")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left_side = seek.join(many, ["family", "at"]).select("family", "at", F.pmod(h, F.col("i_n")).cast("int").alias("i"), numbers("j_n").alias("j"), "rid", "comp", F.lit(True).alias("asks"))
    right_side = docs.withColumnRenamed("step", "at").join(many, ["family", "at"]).select("family", "at", numbers("i_n").alias("i"), F.pmod(h, F.col("j_n")).cast("int").alias("j"), "rid", "comp", F.lit(False).alias("asks"))
    dealt = left_side.select("family", "at", "i", "j", "rid", "comp", "asks").unionByName(right_side.select("family", "at", "i", "j", "rid", "comp", "asks")).join(sets, "rid")

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf.asks.to_numpy(bool)
        size = np.array([len(s) for s in pdf["set"]])
        flat = np.concatenate(list(pdf["set"]))
        owner = np.repeat(np.arange(len(pdf)), size)
        token, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
        often = count > 1
        column = np.cumsum(often) - 1
        hit = often[inverse]
        owner, column, width = owner[hit], column[inverse[hit]], int(often.sum())
        left_rows, right_rows = np.flatnonzero(asks), np.flatnonzero(~asks)
        place = np.empty(len(pdf), np.int64)
        place[left_rows], place[right_rows] = np.arange(len(left_rows)), np.arange(len(right_rows))
        both = np.zeros((len(left_rows), len(right_rows)), np.float32)
        for c in range(0, width, 4096):
            some = (column >= c) & (column < c + 4096)
            o, k = owner[some], column[some] - c
            a, b = np.zeros((len(left_rows), 4096), np.float32), np.zeros((len(right_rows), 4096), np.float32)
            m = asks[o]
            a[place[o[m]], k[m]] = 1
            b[place[o[~m]], k[~m]] = 1
            both += a @ b.T
        o = both.astype(np.int64)
        comp, rid = pdf.comp.to_numpy(), pdf.rid.to_numpy()
        good = (o * 100 >= threshold * (size[left_rows][:, None] + size[right_rows][None, :] - o)) & (comp[left_rows][:, None] != comp[right_rows][None, :])
        x, y = np.nonzero(good)
        x, y = left_rows[x], right_rows[y]
        # what a block's links join, fewer links join as well: a spanning forest of the components they meet
        code = np.unique(comp, return_inverse=True)[1]
        once = np.unique(code[x] * len(pdf) + code[y], return_index=True)[1]
        above = list(range(len(pdf)))
        keep = []
        for k in once.tolist():
            u, v = int(code[x[k]]), int(code[y[k]])
            while above[u] != u:
                above[u] = u = above[above[u]]
            while above[v] != v:
                above[v] = v = above[above[v]]
            if u != v:
                above[u] = v
                keep.append(k)
        x, y = rid[x[keep]], rid[y[keep]]
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return dealt.groupBy("family", "at", "i", "j").applyInPandas(links, "a long, b long").distinct()


def link_components(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """docs: doc_id, text. One row per document: doc_id, n_shingles, component_id (smallest id in reach)."""
    rows = stash(prefix_rows(docs, threshold), "prefixes")
    members = stash(rows.drop("tokens"), "members")
    groups = stash(members.where("n > 0").groupBy("sig").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("least")), "equal-sets")
    copies = stash(members.join(groups, "rid", "left_anti").select("rid"), "copies")
    posts = postings(rows, copies, threshold)
    wanted = stash(members.select("rid", "doc_id", "sig").join(posts.select("rid").distinct(), "rid"), "candidates")
    sets = _sets_of(docs, wanted)
    comps = None
    for turn in range(ROUNDS):
        now = _open(posts, comps)
        now = now.join(_lengths(now), "rid")
        lead = now.groupBy("token").agg(F.min_by(F.struct("rid", "n", "comp", "e", "l"), F.xxhash64("rid", F.lit(turn))).alias("o"))
        met = now.join(lead, "token").where((F.col("o.comp") != F.col("comp")) & _alike("n", "o.n", threshold))
        # the larger set says how far both prefixes reach and how many shingles they share there
        own = F.struct("n", "rid") > F.struct("o.n", "o.rid")
        met = met.withColumn("need", F.when(own, F.col("l")).otherwise(F.col("o.l"))).where((F.col("e") < F.col("need")) & (F.col("o.e") < F.col("need")))
        pairs = met.select(F.least("rid", "o.rid").alias("a"), F.greatest("rid", "o.rid").alias("b"), "need").groupBy("a", "b", "need").agg(F.count("*").alias("c")).where("c >= need").select("a", "b")
        found = stash(_verified(pairs, sets, threshold), "links")
        if not found.limit(1).count():
            break
        comps = merge(comps, found)
    left = _left(posts, comps, sets, threshold)
    near, stuck = _left_pairs(left, threshold)
    found = _verified(near, sets, threshold)
    if stuck.limit(1).count():
        found = found.union(_dense_links(left, stuck, sets, threshold))
    found = stash(found, "links")
    if found.limit(1).count():
        comps = merge(comps, found)
    if comps is None:
        member = groups.select("sig", "least", F.col("rid").alias("comp"))
    else:
        member = groups.join(comps, groups["rid"] == comps["node"], "left").select("sig", "least", F.coalesce("comp", "rid").alias("comp"))
    least = member.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_sig = stash(member.join(least, "comp").select("sig", "component_id"), "components")
    unstash(posts)
    out = members.select("doc_id", "n", "sig").join(by_sig, "sig", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _open(posts: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Entries of the lists that hold more than one component, with comp."""
    if comps is None:
        return posts.withColumn("comp", F.col("rid"))
    now = posts.join(comps, posts["rid"] == comps["node"], "left").select(*posts.columns, F.coalesce("comp", "rid").alias("comp"))
    many = now.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    return now.join(many, "token", "left_semi")


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """docs without the documents that link, over any number of links, with one of a smaller id.

    An id goes if all its rows do; if ids repeat, equal rows of one id are made one.
    """
    found = stash(link_components(docs, threshold).select("doc_id", "component_id"), "linked")
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_and(F.col("doc_id") != F.col("component_id")).alias("goes"))
    gone = stash(ids.where("goes or n > 1").select(F.col("doc_id").alias("_id"), "goes"), "linked-ids")
    out = join_small(docs, gone.where("goes").select("_id"), docs["doc_id"] == F.col("_id"), "left_anti")
    return out.dropDuplicates(["doc_id", "text"]) if gone.where("not goes").limit(1).count() else out
