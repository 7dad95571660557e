"""Exact Jaccard self-join over word shingles, by set relations and position-blocked index lists.

Plan: equal sets are collapsed first (their answers are one answer). Prefix filtering with e(n)
= ``EXTRA + n / EXTRA_PER`` more tokens finds candidates: two sets that link share at least the lesser of their e(n) (or all
they must share) among their first ones in any fixed order, here rare tokens first. Short index
lists are paired and pairs with too few common tokens go; lists of middle length do so by groups that share their smallest
member; long lists only tie their members to that. Components of this candidate graph hold every link; each is cut
into blocks, a block's join being one task: first each block with itself and a few pivots, then what these links leave
outside the component's largest class with all of it.

Within a task, index lists are ascending by set size and cut into position blocks, so blocks of
sizes that can't link are skipped without being read; and a set's overlaps with all others are
derived from those of the set before it, by the lists of the tokens in which the two differ.
A task returns a spanning forest of its links, not the links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ints, shingle_sets, shuffle_partitions, split_batches, text_hash, texts, without_rows, written
from .components import connected_components

#: Prefix tokens that a pair must have in common: so many, and one more for each so many tokens of the smaller set.
EXTRA, EXTRA_PER = 4, 50
#: Index lists up to the first length are paired member by member, up to the second with others of the same smallest member; in longer ones all are tied to that.
SHORT_LIST, LONG_LIST = 32, 256
#: Sets in a block of a candidate component, and tokens in it, about.
BLOCK, BLOCK_TOKENS = 512, 1 << 19
#: Members of a candidate component of several blocks that all its blocks are joined with first.
PIVOTS = 4
#: Positions in a block of an index list.
LIST_BLOCK = 64
#: Documents in the sample that orders tokens by frequency, at least. Any order gives the same links; this one only makes lists short.
ORDER_SAMPLE = 20_000
#: The sample has so many members of a long list on average, however many documents there are: else long lists would be taken for rare tokens.
ORDER_HITS = 10
#: Tokens found in so many sampled documents count as frequent; at most so many are kept for the order.
ORDER_LEAST, ORDER_MOST = 3, 500_000
#: Lists of middle length that give more pairs a member than this tie them instead, so that the rows grow with the lists, not with their square.
DENSE = 16
#: Pairs of middle lists that a task gathers before it hands them on.
PAIR_ROWS = 200_000
#: The lists of middle length that share their smallest member go to so many tasks at most, by token.
HUB_PARTS = 8


def _keyed(documents: DataFrame) -> DataFrame:
    """(doc_id, text, t): as the operators read them; ``t`` tells rows that share an id apart."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash().alias("t"))


def _sets(keyed: DataFrame, k: int) -> DataFrame:
    """(doc_id, t, tokens): the set as ascending little-endian 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in split_batches(batches):
            offsets, hashes = shingle_sets(batch, k)
            blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(offsets * 8), pa.py_buffer(hashes)]).cast(pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(2), blob], ["doc_id", "t", "tokens"])

    return keyed.mapInArrow(run, "doc_id long, t long, tokens binary")


def frequent_tokens(documents: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens ascending, sampled count) of frequent shingles, from a sample drawn by the hash of the id: ``ORDER_SAMPLE`` rows, or the share of all in which long lists show.

    What comes to the driver is at most ``ORDER_MOST`` pairs of numbers, as Arrow columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in split_batches(batches):
            yield pa.record_batch([pa.array(shingle_sets(batch, k)[1].view(np.int64))], ["token"])

    n = documents.count()
    share = min(1.0, max(ORDER_SAMPLE / max(n, 1), ORDER_HITS / LONG_LIST))
    few = texts(documents).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * share))
    top = few.mapInArrow(run, "token long").groupBy("token").count().where(F.col("count") >= ORDER_LEAST).orderBy(F.desc("count"), "token").limit(ORDER_MOST).toArrow()
    tokens, counts = ints(top.column("token")).view(np.uint64), ints(top.column("count"))
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def _signatures(documents: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, t, n, digest, prefix): digest of the whole set, and its first tokens in the common order."""
    spark = documents.sparkSession
    common = spark.sparkContext.broadcast(frequent_tokens(documents, k))  # at most ORDER_MOST pairs of 16 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = common.value
        for batch in split_batches(batches):
            offsets, hashes = shingle_sets(batch, k)
            size = np.diff(offsets)
            rows = np.repeat(np.arange(len(size)), size)
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                freq = np.where(known[at] == hashes, counts[at], 0)
            else:
                freq = np.zeros(len(hashes), np.int64)
            order = np.lexsort((hashes, freq, rows))
            want = np.minimum(size, size + (-percent * size // 100) + EXTRA + size // EXTRA_PER)  # n - ceil(percent * n / 100) + e(n)
            place = np.arange(len(hashes)) - np.repeat(offsets[:-1], size)
            prefix = hashes[order][place < np.repeat(want, size)].view(np.int64)
            digests = [hashlib.blake2b(hashes[offsets[i] : offsets[i + 1]].tobytes(), digest_size=16).digest() for i in range(len(size))]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(want))).astype(np.int32)), pa.array(prefix))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(size.astype(np.int32)), pa.array(digests, pa.binary()), lists], ["doc_id", "t", "n", "digest", "prefix"])

    return _keyed(documents).mapInArrow(run, "doc_id long, t long, n int, digest binary, prefix array<long>")


def _extra(n: Column) -> Column:
    return F.lit(EXTRA) + F.floor(n / F.lit(EXTRA_PER))


def _pruned(listed: DataFrame, percent: int) -> DataFrame:
    """``listed`` without the sets whose tokens in lists are too few for any link, and without lists that this leaves with one member.

    The smaller set of a link shares e(n) prefix tokens with its partner, or all of the at least ``percent`` % of its own that it
    must share; the larger one at least e(percent % of n).
    """
    own = F.count(F.lit(1)).over(Window.partitionBy("doc"))  # as many rows as a set's prefix has tokens
    smaller = F.ceil(F.col("n") * F.lit(percent) / F.lit(100) - F.lit(1e-9))  # of any partner, at least
    least = F.least(_extra(smaller), smaller)
    able = listed.select("token", "doc", "n").withColumn("own", own).where(F.col("own") >= least).drop("own")
    counts = able.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("doc").alias("hub")).where("m > 1")
    return able.join(counts, "token")


def _candidate_edges(postings: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) whose components hold every link, from ``postings(token, doc, n)``."""
    counts = postings.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    listed = written(postings.join(counts.select("token"), "token", "left_semi"))
    for _ in range(2):
        listed = written(_pruned(listed, percent))
    one = F.col("one")
    members = F.array_sort(F.collect_list(F.struct("doc", "n")))
    alike = lambda x, y: F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * percent
    short = listed.where(F.col("m") <= SHORT_LIST).groupBy("token").agg(members.alias("one"))
    paired = F.flatten(F.transform(F.sequence(F.lit(1), F.size(one) - 1), lambda i: F.transform(F.filter(F.slice(one, i + 1, F.size(one)), lambda y: alike(F.element_at(one, i), y)), lambda y: F.struct(F.element_at(one, i).alias("x"), y.alias("y")))))
    pairs = short.select(F.explode(paired).alias("p")).select(F.col("p.x.doc").alias("a"), F.col("p.y.doc").alias("b"), F.col("p.x.n").alias("na"), F.col("p.y.n").alias("nb"), F.lit(1).alias("shared"))

    middle = listed.where((F.col("m") > SHORT_LIST) & (F.col("m") <= LONG_LIST)).withColumn("part", F.pmod(F.xxhash64("token"), F.lit(HUB_PARTS)))
    middle = middle.repartition(shuffle_partitions(listed.sparkSession), "hub", "part")
    counted = written(middle.groupBy("hub", "part", "token").agg(members.alias("one")).sortWithinPartitions("hub", "part").select("hub", "one").mapInArrow(lambda batches: _middle_pairs(batches, percent), "a long, b long, na int, nb int, shared int, sure boolean"))
    pairs = pairs.unionByName(counted.where("NOT sure").drop("sure"))
    must = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent) - F.lit(1e-9))
    near = pairs.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared")).where(F.col("shared") >= F.least(_extra(F.least("na", "nb")), must)).select("a", "b")
    long = listed.where(F.col("m") > LONG_LIST).select(F.col("hub").alias("a"), F.col("doc").alias("b")).where("a <> b").distinct()
    return near.unionByName(counted.where("sure").select("a", "b")).unionByName(long)


def _middle_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb, shared, sure) from lists of middle length that come by their smallest member.

    The lists of a group of near copies come together. Their common tokens are counted for some lists at a time: pairs
    that already share enough are tied, by a forest, and for them nothing more is counted; only for others do counts go on. Where
    these are more than ``DENSE`` a member, they are tied, too: a candidate more never changes the links.
    """
    names = ["a", "b", "na", "nb", "shared", "sure"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def counted(out: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(out)
        codes, first, back = np.unique(rows[:, :2], axis=0, return_index=True, return_inverse=True)
        total = np.bincount(back.ravel(), rows[:, 4], len(codes)).astype(np.int64)
        kept = np.concatenate((rows[first, :4], total[:, None]), 1)
        return pa.record_batch([*(pa.array(kept[:, c]).cast(t) for c, t in enumerate(kinds)), pa.array(np.zeros(len(kept), bool))], names)

    for batch in batches:
        hubs = batch.column(0).to_numpy(zero_copy_only=False)
        one = batch.column(1)
        ends = one.offsets.to_numpy().astype(np.int64)
        docs, sizes = (one.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        up: dict[int, int] = {}

        def root(x: int, up=up) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = up[x]
            return x

        tied: list[tuple[int, int]] = []

        def tie(own: np.ndarray, which: np.ndarray, up=up, root=root, tied=tied) -> None:
            for i, j in np.argwhere(which).tolist():
                x, y = root(int(own[i])), root(int(own[j]))
                if x != y:
                    up[max(x, y)] = min(x, y)
                    tied.append((int(own[i]), int(own[j])))

        out: list[np.ndarray] = []
        gathered, at = 0, 0
        while at < len(hubs):
            # some lists of one hub whose members are at most BLOCK, or one list
            seen, to = set(docs[ends[at] : ends[at + 1]].tolist()), at + 1
            while to < len(hubs) and hubs[to] == hubs[at]:
                more = seen.union(docs[ends[to] : ends[to + 1]].tolist())
                if len(more) > BLOCK:
                    break
                seen, to = more, to + 1
            part = slice(int(ends[at]), int(ends[to]))
            length, at = np.diff(ends[at : to + 1]), to
            if len({root(x) for x in seen}) == 1:
                continue
            own, first, where = np.unique(docs[part], return_index=True, return_inverse=True)
            n = sizes[part][first]
            has = np.zeros((len(own), len(length)), np.float32)
            has[where, np.repeat(np.arange(len(length)), length)] = 1
            shared = (has @ has.T).astype(np.int64)
            low, high = np.minimum.outer(n, n), np.maximum.outer(n, n)
            ok = np.triu((shared > 0) & (100 * low >= percent * high), 1)
            need = np.minimum(EXTRA + low // EXTRA_PER, -(-percent * (low + high) // (100 + percent)))
            tie(own, ok & (shared >= need))
            group = np.array([root(x) for x in own.tolist()])
            open_ = ok & (group[:, None] != group[None, :])
            if open_.sum() > DENSE * len(own):
                tie(own, open_)
                continue
            i, j = np.nonzero(open_)
            if len(i):
                out.append(np.stack((own[i], own[j], n[i], n[j], shared[i, j]), 1))
                gathered += len(i)
            if gathered >= PAIR_ROWS:
                yield counted(out)
                out, gathered = [], 0
        if tied:
            t = np.array(tied)
            zero = pa.array(np.zeros(len(t), np.int32))
            yield pa.record_batch([pa.array(t[:, 0]), pa.array(t[:, 1]), zero, zero, zero, pa.array(np.ones(len(t), bool))], names)
        if out:
            yield counted(out)


def link_block(sets: list[np.ndarray], percent: int, left: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(i, partners of i) among ``sets``, ascending arrays of hashes; with ``left``, only partners on the other side of it.

    ``left`` marks the sets of a first block, the others being of a second one.
    """
    n_sets = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    by_size = np.lexsort((np.array([int(s[0]) if len(s) else 0 for s in sets], np.uint64), size))
    place = np.empty(n_sets, np.int64)
    place[by_size] = np.arange(n_sets)
    sizes = size[by_size]
    every = np.concatenate(sets) if n_sets else np.zeros(0, np.uint64)
    _, token = np.unique(every, return_inverse=True)
    position = np.repeat(place, size)
    n_blocks = (n_sets + LIST_BLOCK - 1) // LIST_BLOCK
    order = np.lexsort((position, token))
    entry, key = position[order], token[order] * n_blocks + position[order] // LIST_BLOCK
    starts = np.concatenate(([0], np.cumsum(size)))
    tokens_of = [np.sort(token[starts[i] : starts[i + 1]]) for i in range(n_sets)]

    def tally(tokens: np.ndarray, first: int, last: int) -> np.ndarray:
        a = np.searchsorted(key, tokens * n_blocks + first, "left")
        b = np.searchsorted(key, tokens * n_blocks + last, "right")
        length = b - a
        if not length.sum():
            return np.zeros(n_sets, np.int64)
        at = np.repeat(a - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
        return np.bincount(entry[at], minlength=n_sets)

    side = None if left is None else left[by_size]
    # sets with the same smallest hashes stand together, so that a set and the one before it are often alike
    walk = sorted(range(n_sets), key=lambda i: (sets[i][:2].tolist(), size[i]))
    base: np.ndarray | None = None
    overlap = np.zeros(n_sets, np.int64)
    span = (0, -1)
    for i in walk:
        n = int(size[i])
        if not n:
            continue
        low = int(np.searchsorted(sizes, -(-percent * n // 100), "left"))
        high = int(np.searchsorted(sizes, n * 100 // percent, "right"))
        blocks = (low // LIST_BLOCK, max(low, high - 1) // LIST_BLOCK)
        fresh = True
        if base is not None and span[0] <= blocks[0] and blocks[1] <= span[1]:
            more, less = np.setdiff1d(tokens_of[i], base, assume_unique=True), np.setdiff1d(base, tokens_of[i], assume_unique=True)
            if len(more) + len(less) < n // 2:
                overlap = overlap + tally(more, *span) - tally(less, *span)
                fresh = False
        if fresh:
            overlap, span = tally(tokens_of[i], *blocks), blocks
        base = tokens_of[i]
        shared = overlap[low:high]
        found = np.flatnonzero(100 * shared >= percent * (n + sizes[low:high] - shared)) + low
        found = found[found != place[i]]
        if side is not None:
            found = found[side[found] != left[i]]
        if len(found):
            yield i, by_size[found]


def _forest(ids: np.ndarray, links: Iterator[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, partners in links:
        for j in partners.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [(int(ids[root(x)]), int(ids[x])) for x in range(len(ids)) if root(x) != x]


def _blocks_of(size: Column, tokens: Column) -> Column:
    return F.least(size, F.ceil(F.greatest(size / BLOCK, tokens / BLOCK_TOKENS))).cast("int")


def _joined_blocks(documents: DataFrame, dealt: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, many): spanning forests of the links within each block (i = j) or between the two blocks (i < j) of ``dealt(doc_id, t, node, component, i, j, mine, many)``."""
    chosen = dealt.select("doc_id", "t").distinct()
    few = dealt.count() <= BROADCAST_ROWS
    sets = _sets(_keyed(documents).join(F.broadcast(chosen) if few else chosen, ["doc_id", "t"], "left_semi").select("doc_id", "text", "t"), k)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, order = np.unique(ints(group.column("node")), return_index=True)  # repeated rows are one set
        mine = ints(group.column("mine"))[order]
        blobs = group.column("tokens")
        sets = [np.frombuffer(blobs[int(x)].as_py(), np.uint64) for x in order]
        del group, blobs  # the table goes before the work begins
        i, j, many = (x.as_py() for x in key[1:])
        edges = _forest(ids, link_block(sets, percent, None if i == j else mine == i))
        return pa.table({"a": pa.array([x for x, _ in edges], pa.int64()), "b": pa.array([y for _, y in edges], pa.int64()), "many": pa.array([many] * len(edges), pa.bool_())})

    joined = sets.join(F.broadcast(dealt) if few else dealt, ["doc_id", "t"]).select("component", "i", "j", "many", "mine", "node", "tokens")
    return joined.groupBy("component", "i", "j", "many").applyInArrow(run, "a long, b long, many boolean")


def _verified_edges(documents: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links inside the candidate components of ``members(node, component, doc_id, t, n)`` that connect whatever links connect.

    A component of one block is joined with itself. In a larger one each block is joined with itself and with a few
    pivots that go to all blocks, which ties most of a group of near copies into one class. What two members of that class have
    to do with each other no longer matters: only the others, in blocks of their own, are joined with each other and with it.
    """
    pivots = F.array_distinct(F.array(*(F.min_by("node", F.xxhash64(F.lit(i), "node")) for i in range(PIVOTS))))
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("tokens"), pivots.alias("pivots"))
    cut = members.join(sizes.select("component", "pivots", _blocks_of(F.col("size"), F.col("tokens")).alias("blocks")), "component")
    cut = written(cut.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    at = F.explode(F.when(F.array_contains("pivots", F.col("node")), everywhere).otherwise(F.array("mine")))
    own = cut.withColumn("i", at).select("doc_id", "t", "node", "component", "i", F.col("i").alias("j"), F.col("i").alias("mine"), (F.col("blocks") > 1).alias("many"))
    edges = written(_joined_blocks(documents, own, k, percent))
    large = cut.where("blocks > 1").select("component", "node", "doc_id", "t", "n")
    if large.isEmpty():
        return edges.select("a", "b")
    tied = connected_components(edges.where("many")).withColumnRenamed("component", "class")
    tied = written(large.join(tied, "node", "left").withColumn("class", F.coalesce("class", "node")))
    most = tied.groupBy("component", "class").count().groupBy("component").agg(F.max_by("class", F.struct("count", "class")).alias("most"))
    told = tied.join(most, "component").withColumn("rest", F.col("class") != F.col("most"))

    def sums(which: Column) -> tuple[Column, Column]:
        return F.sum(which.cast("long")), F.sum(F.when(which, F.col("n")).otherwise(0))

    rests = told.groupBy("component").agg(_blocks_of(*sums(F.col("rest"))).alias("rests"), F.greatest(_blocks_of(*sums(~F.col("rest"))), F.lit(1)).alias("blocks")).where("rests > 0")
    told = written(told.join(rests, "component").select("component", "node", "doc_id", "t", "rest", "rests", "blocks"))
    if told.isEmpty():
        return edges.select("a", "b")
    hashed = F.xxhash64("node")
    mine = F.when(F.col("rest"), F.pmod(hashed, F.col("rests"))).otherwise(F.col("rests") + F.pmod(hashed, F.col("blocks"))).cast("int")
    meets = F.explode(F.sequence(F.lit(0), F.when(F.col("rest"), F.col("rests") + F.col("blocks")).otherwise(F.col("rests")) - 1))
    dealt = told.withColumn("mine", mine).withColumn("other", meets).select("doc_id", "t", "node", "component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", F.lit(True).alias("many"))
    return edges.unionByName(_joined_blocks(documents, dealt, k, percent)).select("a", "b")


def _classes(documents: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, t, n, component_id, first): each row, its class, and whether it is the one that stands for that.

    A node of the graph is a different set. Its number ascends with the smallest id that has it, so that the least node of a component has the
    smallest id of all, also where rows share an id.
    """
    documents = documents.where("doc_id IS NOT NULL")
    found = written(_signatures(documents, k, percent))
    least = written(found.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id")))
    ranges = least.repartitionByRange(shuffle_partitions(documents.sparkSession), "doc_id", "digest").sortWithinPartitions("doc_id", "digest")
    first = written(ranges.withColumn("node", F.monotonically_increasing_id()))
    sets = found.where("n > 0").join(F.broadcast(first) if first.count() <= BROADCAST_ROWS else first, ["digest", "doc_id"])
    postings = sets.select(F.explode("prefix").alias("token"), F.col("node").alias("doc"), "n")
    members = connected_components(_candidate_edges(postings, percent))
    members = written(members.join(sets.select("node", "doc_id", "t", "n"), "node").dropDuplicates(["node"]))  # all rows of a node have its set
    classes = written(connected_components(_verified_edges(documents, members, k, percent)))
    of = first.join(classes, "node", "left").select("digest", "node", F.col("doc_id").alias("owner"), F.coalesce("component", "node").alias("component"))
    named = of.join(first.select(F.col("node").alias("component"), F.col("doc_id").alias("component_id")), "component")
    named = named.select("digest", "owner", "component_id", (F.col("node") == F.col("component")).alias("least"))
    return (
        found.select("doc_id", "t", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(named, "digest", "left")
        .select("doc_id", "t", "n", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("least") & (F.col("doc_id") == F.col("owner")), F.lit(True)).alias("first"))
    )


def jaccard_classes(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): each document, the size of its set, and the smallest document reachable by links.

    A set holds a text's distinct ``k``-word shingles (all words as one shingle if fewer); two documents link when
    ``100 * intersection >= percent * union``. A document without words, null and empty texts included, links with
    nothing and is a class of its own. Rows that share an id are documents of their own, each with its own set, links and
    class; repeated rows are returned as often. Null ids take no part and are not returned. Other columns are not read. A
    text may be as long as a row can be. The table may be empty.
    """
    return _classes(documents, k, percent).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def first_of_classes(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents`` that stand for their class of :func:`jaccard_classes`: those with its smallest id, and of these one set's.

    Rows without words and rows with a null id all stay. Rows equal in id and text stay or go together. All columns are kept.
    """
    gone = _classes(documents, k, percent).where("NOT first").select("doc_id", "t").distinct()
    return without_rows(documents, written(gone))
