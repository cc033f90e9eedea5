"""Similarity join of documents on their sets of word n-grams, with a prefix tree.

Two documents link when ``100 * |A n B| >= percent * |A u B|``. The result is one
row per document with the smallest id of its linked group; links between equal
sets are not listed, and no link between different sets is lost.

1. *Who can have a partner at all.* A document with a partner shares at least
   ``percent`` of its n-grams with other documents. Each task packs the n-gram
   hashes of its documents by hash bucket (4 bytes for each n-gram, no rows); a
   bucket task answers how many n-grams of each document others have too.
2. *Who could link.* For one document of each distinct set that is left, n-grams
   are ordered by document frequency. Linked sets share an n-gram among their
   first ``n - ceil(percent n / 100) + 1`` ones; a set that shares none of these
   is left out. The others are cut into more parts, by hash, than linked sets of
   their sizes can differ in, so linked sets agree on a whole part. Sets that are
   not connected through equal parts cannot link: connected groups are joined on
   their own. One n-gram that texts share by chance connects nothing, so groups
   do not grow together as the table grows.
3. *The join.* A group's sets stand as what they differ in from the n-grams that
   most of them have; two sets differ in as many n-grams as their differences do.
   These differences, in one order of n-grams, form a prefix tree. A set is matched
   against the whole tree at once: sets below a node share the overlap counted on
   the way to it, and a subtree is left as soon as the overlap so far and the
   n-grams that remain cannot reach the bound. Sets already in one component are
   not compared again.
4. Groups with more than ``LIMIT`` n-grams are dealt into blocks. Blocks are
   joined within, then one set of each component found; what is still apart from
   its group's largest component meets all blocks. That last step is exact.

Long documents are packed like others. Frequencies are counted over all
documents, in as many buckets as there are shuffle partitions (times two).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions.skew import broadcast_if_small
from casewright.llm.registry import query, table
from casewright.llm.rows import free_name, numbered
from casewright.operators.graph import components
from casewright.session import cut_lineage, rows_at_once

WORDS = 3
PERCENT = 90
# n-grams one join task may hold (8 bytes each, some 100 MB with its tree).
LIMIT = 3_000_000
# Documents packed together.
PACK = 1500

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_set(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct word n-grams; a shorter text is one gram as a whole, an empty one none."""
    tokens = (text or "").encode("utf-8").translate(LOWER).split()  # bytes split at ASCII white space only
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))  # faster than to look them up
    size = min(words, len(h))
    n = len(h) - size + 1
    mixed = np.full(n, size, np.uint64)
    for i in range(size):
        mixed = _mixed(mixed * ODD + h[i : i + n])
    mixed.sort()
    return mixed[np.concatenate([[True], mixed[1:] != mixed[:-1]])]


def _least(n: int | np.ndarray, percent: int):
    """The smallest overlap a set of n can have with any partner."""
    return -(-percent * n // 100)


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


# --- equal parts ---------------------------------------------------------------------------------------------------------


@lru_cache
def _bands(percent: int) -> np.ndarray:
    """Where bands of set sizes start; sets that link are of one band or of two that follow each other."""
    starts = [1, 2]
    while starts[-1] < 1 << 40:
        starts.append(max(starts[-1] + 1, 100 * (starts[-1] - 1) // percent + 1))
    return np.array(starts)


def _marks(grams: np.ndarray, shared: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of which two different sets that link have one in common; ``shared``: the n-grams of step 2 a set shares.

    Sets of two bands that link differ in ``apart`` n-grams at most. Cut into more
    parts than that by hash, they agree on ``spare`` parts or more. Sets with as many
    empty parts might agree on these alone: for them the shared n-grams stand, as
    they do for sets too small to be cut.
    """
    if percent >= 100:
        return np.zeros(0, np.uint64)  # only equal sets link
    starts = _bands(percent)
    band = int(np.searchsorted(starts, len(grams), "right")) - 1
    marks = [np.zeros(0, np.uint64)]
    for first in range(max(0, band - 1), band + 1):  # the set's partners are in bands first and first + 1
        apart = int((100 - percent) * (starts[first + 1] + starts[first + 2] - 2) // (100 + percent))
        if apart == 0:
            continue
        spare = 2 + apart // 8
        parts = apart + spare
        names = _mixed((np.uint64(first) << np.uint64(32)) + np.arange(parts + 1, dtype=np.uint64))
        if 2 * parts > starts[first]:
            marks.append(shared + names[parts])
            continue
        sizes = np.bincount((((grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64), minlength=parts)
        ends = _offsets(sizes)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(grams), dtype=np.uint64)])  # grams ascend, and parts with them
        marks.append((total[ends[1:]] - total[ends[:-1]] + names[:parts])[sizes > 0])
        if (sizes == 0).sum() >= spare:
            marks.append((shared + names[:parts][sizes == 0][:, None]).ravel())
    return _mixed(np.concatenate(marks))


# --- counting in buckets -------------------------------------------------------------------------------------------------

ASK = "bucket int, batch string, grams binary, sizes binary, own binary, keys array<string>, digests array<string>, rows binary"


def _bucket(flat: np.ndarray, buckets: int) -> np.ndarray:
    return (((flat >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.uint16)


def _ask(batch: str, sets: list[np.ndarray], buckets: int, keep: bool, **own) -> pd.DataFrame:
    """Rows for each bucket with the lower hash halves of a batch's grams, and one row that comes back to the batch."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    doc = np.repeat(np.arange(len(sets)), sizes)
    place = _bucket(flat, buckets)
    order = np.argsort(place, kind="stable")
    low = flat[order].astype("<u4")
    ends = _offsets(np.bincount(place, minlength=buckets))
    counts = np.bincount(place.astype(np.int64) * len(sets) + doc, minlength=buckets * len(sets)).reshape(buckets, len(sets))
    empty = dict.fromkeys(("grams", "own", "keys", "digests", "rows"))
    rows = [
        empty | {"bucket": b, "batch": batch, "grams": low[ends[b] : ends[b + 1]].tobytes(), "sizes": _thin(counts[b])}
        for b in range(buckets) if ends[b + 1] > ends[b]
    ]
    rows.append(empty | {"bucket": xxhash.xxh32_intdigest(batch) % buckets, "batch": batch, "sizes": sizes.astype("<u4").tobytes(), "own": flat.tobytes() if keep else b""} | own)
    return pd.DataFrame(rows, columns=["bucket", "batch", "grams", "sizes", "own", "keys", "digests", "rows"], dtype=object)


def _thin(counts: np.ndarray) -> bytes:
    """Counts in two bytes each where they fit, in four else; the first byte says which."""
    return b"2" + counts.astype("<u2").tobytes() if counts.max(initial=0) < 65536 else b"4" + counts.astype("<u4").tobytes()


def _thick(data: bytes) -> np.ndarray:
    return np.frombuffer(data[1:], "<u2" if data[:1] == b"2" else "<u4").astype(np.int64)


def _answer(each: bool):
    """A bucket's work: how many documents have each gram (1 to 255), or how many grams of each document others have."""

    def work(asked: pd.DataFrame) -> pd.DataFrame:
        returned = asked[asked["own"].notna()].assign(answer=None)
        asked = asked[asked["own"].isna()]
        grams = [np.frombuffer(g, "<u4") for g in asked["grams"]]
        answers = []
        if grams:
            flat = np.concatenate(grams)
            order = np.argsort(flat, kind="stable")
            ordered = flat[order]
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            times = np.diff(np.append(first, len(ordered)))
            found = np.empty(len(flat), np.uint8)
            found[order] = np.repeat(np.minimum(times, 255), times)
            at = 0
            for g, sizes in zip(grams, asked["sizes"], strict=True):
                own = found[at : at + len(g)]
                at += len(g)
                if each:
                    answers.append(own.tobytes())
                else:
                    shared = np.concatenate([[0], np.cumsum(own > 1)])
                    ends = _offsets(_thick(sizes))
                    answers.append(_thin(shared[ends[1:]] - shared[ends[:-1]]))
        sent = asked[["bucket", "batch"]].assign(sizes=None, own=None, keys=None, digests=None, rows=None, answer=answers)
        columns = ["bucket", "batch", "sizes", "own", "keys", "digests", "rows", "answer"]
        return pd.concat([returned[columns], sent[columns]]).astype(object) if len(returned) else sent[columns].astype(object)

    return work


ANSWER = "bucket int, batch string, sizes binary, own binary, keys array<string>, digests array<string>, rows binary, answer binary"


def _buckets(spark: SparkSession) -> int:
    return min(65536, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def facts(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(row, key, n, digest, active): size and digest of each document's set, and whether it can have a partner."""
    buckets = _buckets(docs.sparkSession)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number = TaskContext.get().partitionId(), 0
        for frame in batches:
            for at in range(0, len(frame), PACK):
                part = frame.iloc[at : at + PACK]
                sets = [gram_set(t, words) for t in part["text"]]
                yield _ask(
                    f"{task}-{number}", sets, buckets, False, keys=part["key"].tolist(),
                    digests=[hashlib.md5(s.tobytes(), usedforsecurity=False).hexdigest() for s in sets],
                    rows=part["row"].to_numpy("<i8").tobytes(),
                )
                number += 1

    def gather(answered: pd.DataFrame) -> pd.DataFrame:
        own = answered[answered["own"].notna()].iloc[0]
        sizes = np.frombuffer(own["sizes"], "<u4").astype(np.int64)
        shared = np.zeros(len(sizes), np.int64)
        for answer in answered["answer"][answered["own"].isna()]:
            shared += _thick(answer)
        return pd.DataFrame(
            {
                "row": np.frombuffer(own["rows"], "<i8"), "key": pd.Series(list(own["keys"]), dtype=object), "n": sizes,
                "digest": pd.Series(list(own["digests"]), dtype=object), "active": (sizes > 0) & (100 * shared >= percent * sizes),
            }
        )

    lean = numbered(docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text")), "row")
    answered = lean.mapInPandas(ask, ASK).groupBy("bucket").applyInPandas(_answer(False), ANSWER)
    with rows_at_once(docs.sparkSession, PACK):
        return cut_lineage(answered.groupBy("batch").applyInPandas(gather, "row long, key string, n long, digest string, active boolean"))


def candidates(docs: DataFrame, known: DataFrame, text_col: str, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(digest, n, grams, marks): one of each distinct set that can have a different partner, with hashes it shares with any."""
    spark = docs.sparkSession
    buckets = _buckets(spark)
    chosen = cut_lineage(known.where("active").groupBy("digest").agg(F.min("row").alias("row")).select("row"))
    texts = numbered(docs.select(F.col(text_col).alias("text")), "row").join(broadcast_if_small(chosen), "row", "left_semi")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number = TaskContext.get().partitionId(), 0
        for frame in batches:
            for at in range(0, len(frame), PACK):
                sets = [gram_set(t, words) for t in frame["text"].iloc[at : at + PACK]]
                digests = [hashlib.md5(s.tobytes(), usedforsecurity=False).hexdigest() for s in sets]
                yield _ask(f"{task}-{number}", sets, buckets, True, digests=digests)
                number += 1

    def gather(answered: pd.DataFrame) -> pd.DataFrame:
        own = answered[answered["own"].notna()].iloc[0]
        flat, sizes = np.frombuffer(own["own"], np.uint64), np.frombuffer(own["sizes"], "<u4").astype(np.int64)
        place = _bucket(flat, buckets)
        order = np.argsort(place, kind="stable")
        ends = _offsets(np.bincount(place, minlength=buckets))
        often = np.empty(len(flat), np.uint8)
        for bucket, answer in zip(answered["bucket"][answered["own"].isna()], answered["answer"][answered["own"].isna()], strict=True):
            often[order[ends[bucket] : ends[bucket + 1]]] = np.frombuffer(answer, np.uint8)
        out = []
        at = _offsets(sizes)
        for i, n in enumerate(sizes.tolist()):
            grams, df = flat[at[i] : at[i + 1]], often[at[i] : at[i + 1]]
            first = np.lexsort((grams, df))[: n - _least(n, percent) + 1]
            shared = grams[first[df[first] > 1]]
            marks = _marks(grams, shared, percent) if len(shared) else shared
            if len(marks):
                out.append((own["digests"][i], n, grams.tobytes(), marks.view(np.int64).tolist()))
        return pd.DataFrame(out, columns=["digest", "n", "grams", "marks"]).astype({"digest": object, "n": np.int64, "grams": object, "marks": object})

    answered = texts.select("text").mapInPandas(ask, ASK).groupBy("bucket").applyInPandas(_answer(True), ANSWER)
    with rows_at_once(spark, PACK):
        return cut_lineage(answered.groupBy("batch").applyInPandas(gather, "digest string, n long, grams binary, marks array<long>"))


# --- the prefix tree -----------------------------------------------------------------------------------------------------


class PrefixTree:
    """Sets of ranks in ascending order, as a tree in which sets with equal beginnings share their nodes.

    A node covers the sets ``low`` to ``high`` of the sorted list, which agree on
    their first ``depth`` ranks; its edge holds those beyond its parent's. Two sets
    link when ``share`` times their overlap reaches the sum of their weights.
    """

    def __init__(self, sets: list[np.ndarray], weights: np.ndarray, share: int):
        coded = [s.astype(">u4").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=coded.__getitem__)
        self.sets = [sets[i] for i in self.order]
        self.weights, self.share = weights[self.order], share
        lengths = np.array([len(s) for s in self.sets], np.int64)
        n = len(sets)
        agree = np.zeros(n + 1, np.int64)  # with the set before
        for i in range(1, n):
            a, b = self.sets[i - 1], self.sets[i]
            m = min(len(a), len(b))
            other = a[:m] != b[:m]
            agree[i] = other.argmax() if other.any() else m
        low, high, depth, above, first_child, children = [0], [n], [0], [0], [], []
        edges = []
        at = 0
        while at < len(low):  # breadth first, so the children of a node stand together
            a, b, parent = low[at], high[at], above[at]
            d = int(agree[a + 1 : b].min()) if b - a > 1 else len(self.sets[a])
            depth[at] = d
            edges.append(self.sets[a][parent:d])
            first_child.append(len(low))
            if b - a > 1:
                cuts = [a, *(a + 1 + np.flatnonzero(agree[a + 1 : b] == d)).tolist(), b]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    low.append(lo)
                    high.append(hi)
                    depth.append(0)
                    above.append(d)
            children.append(len(low) - first_child[-1])
            at += 1
        self.low, self.high, self.depth = np.array(low), np.array(high), np.array(depth)
        self.first_child, self.children = np.array(first_child), np.array(children)
        self.edge_at = _offsets(np.array([len(e) for e in edges]))
        self.edge = np.concatenate([*edges, np.zeros(0, np.uint32)]).astype(np.int64)
        self.last = np.where(self.edge_at[1:] > self.edge_at[:-1], self.edge[np.maximum(self.edge_at[1:] - 1, 0)] if len(self.edge) else 0, -1)
        starts = self.low
        self.most = np.array([lengths[a:b].max() for a, b in zip(low, high, strict=True)])
        self.least = np.array([self.weights[a:b].min() for a, b in zip(low, high, strict=True)])
        self.leaf = (self.high - starts) == 1

    def partners(self, probe: np.ndarray, weight: int, alive: np.ndarray, marked: np.ndarray) -> list[int]:
        """Places of the sets that are alive and link with the probe, whose ranks are set in ``marked``."""
        n = len(probe)
        living = np.concatenate([[0], np.cumsum(alive)])
        nodes, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        left = np.full(1, n, np.int64)
        found: list[int] = []
        while len(nodes):
            a, b = self.edge_at[nodes], self.edge_at[nodes + 1]
            sizes = b - a
            ends = np.cumsum(sizes)
            if sizes.any():
                hit = marked[self.edge[np.arange(ends[-1]) - np.repeat(ends - sizes - a, sizes)]]
                total = np.concatenate([[0], np.cumsum(hit)])
                overlap = overlap + total[ends] - total[ends - sizes]
                left = np.where(sizes > 0, n - np.searchsorted(probe, self.last[nodes], "right"), left)
            reach = overlap + np.minimum(left, self.most[nodes] - self.depth[nodes])
            keep = (self.share * reach >= weight + self.least[nodes]) & (living[self.high[nodes]] > living[self.low[nodes]])
            nodes, overlap, left = nodes[keep], overlap[keep], left[keep]
            leaf = self.leaf[nodes]  # nothing is left to reach there
            found += self.low[nodes[leaf & (self.share * overlap >= weight + self.least[nodes])]].tolist()
            nodes, overlap, left = nodes[~leaf], overlap[~leaf], left[~leaf]
            count = self.children[nodes]
            ends = np.cumsum(count)
            step = np.arange(ends[-1] if len(ends) else 0)
            nodes, overlap, left = step - np.repeat(ends - count - self.first_child[nodes], count), np.repeat(overlap, count), np.repeat(left, count)
        return found


def _differences(grams: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, int]:
    """Ranks of what each set differs in from the grams most sets have, how many these are, and the number of ranks.

    What only one set differs in has no rank, as it is in no overlap.
    """
    ranked, where = np.unique(np.concatenate(grams), return_inverse=True)
    at = _offsets(np.array([len(g) for g in grams]))
    usual = 2 * np.bincount(where, minlength=len(ranked)) > len(grams)
    common = np.flatnonzero(usual)
    parts = []
    for i in range(len(grams)):
        own = where[at[i] : at[i + 1]]
        parts += [own[~usual[own]], np.setdiff1d(common, own, assume_unique=True)]
    apart = [np.concatenate(parts[i : i + 2]) for i in range(0, len(parts), 2)]
    often = np.bincount(np.concatenate(apart), minlength=len(ranked))
    rank = np.empty(len(ranked), np.int64)
    rank[np.lexsort((ranked, -often))] = np.arange(len(ranked))  # frequent first: equal beginnings are shared
    return [np.sort(rank[d[often[d] > 1]]).astype(np.uint32) for d in apart], np.array([len(d) for d in apart]), int((often > 1).sum())


def tree_links(grams: list[np.ndarray], labels: list, probes: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that join the components of a list of sets, at most one for each two components.

    Sets with equal labels count as joined from the start; ``probes`` says which
    sets are matched against all others.
    """
    sets, apart, ranks = _differences(grams)
    # Of n and m grams, d of them in one set only, the sets link when d (100 + percent) <= (n + m) (100 - percent).
    weights = (100 + percent) * apart - (100 - percent) * np.array([len(g) for g in grams])
    tree = PrefixTree(sets, weights, 2 * (100 + percent))
    place = np.empty(len(sets), np.int64)
    place[tree.order] = np.arange(len(sets))
    _, group = np.unique(np.array(labels, dtype=object).astype(str), return_inverse=True)
    group = group[tree.order]
    members = {g: np.flatnonzero(group == g).tolist() for g in np.unique(group)} if len(set(group.tolist())) < len(group) else {g: [i] for i, g in enumerate(group.tolist())}
    open_ = np.ones(len(sets), bool)
    marked = np.zeros(ranks, np.int64)
    links = []

    def match(i: int) -> None:
        p = place[i]
        open_[p] = False
        alive = open_ & (group != group[p])
        if not alive.any():
            return
        probe = tree.sets[p].astype(np.int64)
        marked[probe] = 1
        for q in tree.partners(probe, weights[i], alive, marked):
            if alive[q] and group[q] != group[p]:
                links.append((i, tree.order[q]))
                small, large = sorted((group[q], group[p]), key=lambda g: len(members[g]))
                group[members[small]] = large
                members[large] += members.pop(small)
        marked[probe] = 0

    todo = np.flatnonzero(probes)
    todo = todo[np.argsort(weights[todo], kind="stable")].tolist()
    for i in todo[:1]:  # the set in the middle links with most
        match(i)
    for i in sorted(todo[1:], key=lambda i: len(members[group[place[i]]])):  # then, sets of one large component mostly have none left to meet
        match(i)
    return links


EDGE = "a string, b string"


def _links(frame: pd.DataFrame, percent: int, labels=None, probes=None) -> pd.DataFrame:
    frame = frame.reset_index(drop=True)
    names = frame["digest"].tolist()
    grams = [np.frombuffer(g, np.uint64) for g in frame["grams"]]
    found = tree_links(grams, names if labels is None else frame[labels].tolist(), np.ones(len(names), bool) if probes is None else frame[probes].to_numpy(bool), percent) if len(names) > 1 else []
    return pd.DataFrame({"a": pd.Series([names[a] for a, _ in found], dtype=object), "b": pd.Series([names[b] for _, b in found], dtype=object)})


def _labelled(sets: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links, "a", "b").withColumnRenamed("node", "digest").withColumnRenamed("component", "label")
    return sets.drop("label").join(found, "digest", "left").withColumn("label", F.coalesce("label", "digest"))


def _block_links(big: DataFrame, limit: int, percent: int) -> DataFrame:
    """Links of groups too large for a task: within blocks, among one set of each component, then of what is still apart."""
    inner = lambda df: df.groupBy("group", "block").applyInPandas(lambda f: _links(f, percent), EDGE)
    blocks = F.ceil(F.col("weight") / limit).cast("int")
    big = cut_lineage(big.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("digest"), "blocks").cast("int")))
    links = cut_lineage(inner(big))
    state = cut_lineage(_labelled(big, links))
    while True:  # one set of each component found so far, dealt anew, until blocks find nothing or hold a whole group
        chosen = state.where("digest = label")
        weight = chosen.groupBy("group").agg(F.sum("n").alias("_w"))
        dealt = chosen.join(weight, "group").withColumn("blocks", F.ceil(F.col("_w") / limit).cast("int")).withColumn("block", F.pmod(F.xxhash64("digest", F.lit(1)), "blocks").cast("int"))
        more = cut_lineage(inner(dealt.drop("_w")))
        if more.isEmpty():
            break
        links = cut_lineage(links.unionByName(more))
        state = cut_lineage(_labelled(state, links))
        if dealt.where("blocks > 1").isEmpty():
            break
    largest = state.groupBy("group", "label").agg(F.sum("n").alias("s")).groupBy("group").agg(F.max(F.struct("s", "label")).alias("m"))
    apart = state.join(largest, "group").withColumn("apart", F.col("label") != F.col("m.label")).drop("m")
    apart = cut_lineage(apart)
    rest = apart.where("apart").groupBy("group").agg(F.ceil(F.sum("n") / limit).cast("int").alias("rests"))
    left = apart.where("apart").join(rest, "group").withColumn("one", F.pmod(F.xxhash64("digest", F.lit(2)), "rests").cast("int"))
    left = left.withColumn("two", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("probe", F.lit(True))
    right = apart.join(rest, "group").withColumn("one", F.explode(F.sequence(F.lit(0), F.col("rests") - 1))).withColumn("two", F.col("block")).withColumn("probe", F.lit(False))
    columns = ["group", "one", "two", "digest", "n", "grams", "label", "probe"]

    def cross(frame: pd.DataFrame) -> pd.DataFrame:
        # A set that is on both sides stays once, as a probe.
        return _links(frame.sort_values("probe", ascending=False).drop_duplicates("digest"), percent, "label", "probe")

    crossed = left.select(*columns).unionByName(right.select(*columns)).groupBy("group", "one", "two").applyInPandas(cross, EDGE)
    return links.unionByName(crossed)


def link(sets: DataFrame, percent: int = PERCENT, limit: int = LIMIT) -> DataFrame:
    """(a, b): links between distinct sets that connect whatever all links connect."""
    entries = sets.select("digest", F.explode("marks").alias("mark"))
    low = entries.groupBy("mark").agg(F.min("digest").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    near = cut_lineage(entries.join(low, "mark").where("digest <> low").select("digest", "low").distinct())
    groups = components(near, "digest", "low").select(F.col("node").alias("digest"), F.col("component").alias("group"))
    grouped = sets.select("digest", "n", "grams").join(groups, "digest")
    weights = grouped.groupBy("group").agg(F.sum("n").alias("weight"))
    weighed = cut_lineage(grouped.join(weights, "group"))
    links = weighed.where(F.col("weight") <= limit).groupBy("group").applyInPandas(lambda f: _links(f, percent), EDGE)
    big = weighed.where(F.col("weight") > limit)
    if big.isEmpty():
        return links
    return links.unionByName(_block_links(big, limit, percent))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, limit: int = LIMIT) -> DataFrame:
    """(row, id_col, n_shingles, component_id, keep_row): one row per document.

    ``row`` is the row's number in ``docs`` and ``keep_row`` that of the group's
    row with the smallest id (null ids last, then the first row). Null, empty and
    white-space texts have no n-grams and link with nothing; repeated rows link
    with each other; extra columns are not read; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType
    known = facts(docs, id_col, text_col, words, percent).withColumn("id", F.col("key").cast(kind)).drop("key")
    links = cut_lineage(link(candidates(docs, known, text_col, words, percent), percent, limit))
    joined = components(links, "a", "b").withColumnRenamed("node", "digest")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("row").alias("row")))
    classes = known.where("active").groupBy("digest").agg(first.alias("best")).join(joined, "digest", "left")
    classes = classes.withColumn("component", F.coalesce("component", "digest"))
    best = classes.groupBy("component").agg(F.min("best").alias("best"))
    labels = classes.select("digest", "component").join(best, "component").select("digest", F.col("best.id").alias("component_id"), F.col("best.row").alias("keep_row"))
    linked = known.where("active").join(labels, "digest")
    alone = known.where("NOT active").withColumn("component_id", F.col("id")).withColumn("keep_row", F.col("row"))
    columns = ["row", F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "keep_row"]
    return linked.select(*columns).unionByName(alone.select(*columns))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when one of each near-duplicate group stays, with exactly their columns.

    Of a group the row with the smallest id stays. ``docs`` has to be a table read
    from files or a checkpoint, as its rows are told apart by their place.
    """
    row = free_name(docs, "_row")
    gone = cut_lineage(near_groups(docs, id_col, text_col, words, percent).where("row <> keep_row").select(F.col("row").alias(row)))
    return numbered(docs, row).join(broadcast_if_small(gone), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


@query()
def op8_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its linked group, by 3-word n-grams at 90 percent."""
    return near_groups(table(spark, folder, "documents")).drop("row", "keep_row")
