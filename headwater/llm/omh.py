"""Near-duplicate documents by Order MinHash over word shingles, verified by banded alignment.

A sketch takes the two least hashes of a document's occurrence-labelled 5-word shingles and keeps them in text order;
two documents share it with a chance near the square of their similarity. Documents with equal words are one from the
start. Two texts are compared if they share `common` of the SKETCHES sketches, a number that texts at the limit reach
but for one pair in a million (`shared_at_least`). Whoever shares so many shares one of its rarest, too: each document
leaves out its most frequent buckets, all but SKETCHES - common + 1, and so the buckets of a common passage empty.

Two steps find all links that matter. Inside: each document goes home to the least leader of its buckets that it shares
enough with, and all in a home are compared with one another, in blocks of bounded size that hold the leader too.
Between: for documents of several classes and homes that meet in a bucket, the pairs with enough common sketches are
aligned, best first, until no two classes have a pair left. Classes are the closure of the links, by label propagation.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.llm.common import byte_values, materialize, sieved, sliced, trimmed
from headwater.llm.cover import grams, mix, word_hashes
from headwater.llm.wumanber import words

SHINGLE, SKETCHES = 5, 32
SIMILARITY = 0.8
#: The chance to miss a pair at the limit that `shared_at_least` allows.
MISSED = 1e-6
PIECE_BYTES = 1 << 19
#: A home's documents are compared in blocks of so many documents and shingles; beyond, they are dealt over several.
BLOCK_DOCS, BLOCK_SHINGLES = 4096, 1 << 20
#: Documents of a bucket that one task compares with as many others.
BUCKET_DOCS = 4096
#: Pairs of one document with one other class that are aligned in the first round.
FIRST_PAIRS = 512
#: Edges that one task closes to classes; beyond, labels are passed on from node to node.
TASK_EDGES = 1 << 20
#: Members of a leader that are aligned in one task's group.
GROUP = 64
#: Shingles from which a text's sketches are taken one after the other.
LONG = 1 << 14
U = np.uint64
TOP = U(2**64 - 1)
SEEDS = np.random.default_rng(5).integers(0, 2**63, SKETCHES, dtype=U) * U(2) + U(1)


def shared_at_least(similarity: float) -> int:
    """The most sketches that two texts of this similarity share but for a chance of MISSED."""
    p, total = similarity**2, 0.0
    for k in range(SKETCHES):
        total += math.comb(SKETCHES, k) * p**k * (1 - p) ** (SKETCHES - k)
        if total > MISSED:
            return max(1, k)
    return SKETCHES


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(occurrence-labelled shingle hashes of all texts on end, their number by text, words joined by a space)."""
    joined = [b" ".join(words(t)) for t in texts]
    buf = np.frombuffer(b" ".join(joined) + b" ", np.uint8)
    offsets = np.cumsum([0, *(len(x) + 1 for x in joined)])
    edge = np.flatnonzero(np.diff((buf == 32).view(np.int8), prepend=1))
    starts, ends = edge[0::2], edge[1::2]
    n = np.bincount(np.searchsorted(offsets, starts, side="right") - 1, minlength=len(texts))
    first = np.cumsum(n) - n
    h = word_hashes(buf, starts, ends, 0)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(texts)), count)
    at = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    out = np.zeros(len(doc), U)
    short = n[doc] < SHINGLE
    if (~short).any():
        out[~short] = grams(h, SHINGLE, 0)[at[~short]]
    for k in np.flatnonzero(short).tolist():  # a text of under five words is one shingle
        i = doc[k]
        out[k] = grams(h[first[i] : first[i] + n[i]], int(n[i]), 0)[0]
    order = np.lexsort((out, doc))
    new = np.ones(len(out), bool)
    new[1:] = (out[order][1:] != out[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    run = np.flatnonzero(new)
    nth = np.empty(len(out), np.int64)
    nth[order] = np.arange(len(out)) - np.repeat(run, np.diff(np.append(run, len(out))))
    again = nth > 0
    out[again] = mix(out[again] + nth[again].astype(U) * U(0x9E3779B97F4A7C15))
    return out, count, joined


def sketch(h: np.ndarray) -> np.ndarray:
    """SKETCHES hashes of one text's shingles, 0 without: the two least shingles in text order."""
    n = len(h)
    if not n:
        return np.zeros(SKETCHES, U)
    if n > LONG:
        return np.concatenate([_sketch(h, SEEDS[k : k + 1], k) for k in range(SKETCHES)])
    return _sketch(h, SEEDS, 0)


def _sketch(h: np.ndarray, seeds: np.ndarray, first: int) -> np.ndarray:
    v = h[None, :] * seeds[:, None]
    v ^= v >> U(31)
    at = np.arange(len(seeds))
    salt = U(first) + at.astype(U)
    one = v.argmin(axis=1)
    a = v[at, one]
    if len(h) == 1:
        return mix(a + salt)
    v[at, one] = TOP
    two = v.argmin(axis=1)
    b = v[at, two]
    forward = one <= two
    return mix(np.where(forward, a, b) * U(0x9E3779B97F4A7C15) + np.where(forward, b, a) + salt)


FEATURES = "doc_id long, n_words long, digest binary, n_shingles long, sketches array<long>"


def features(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, a digest of the words, the number of shingles, the sketches (and the text) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_values(batch["text"])
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size < PIECE_BYTES):
                    size += len(texts[b])
                    b += 1
                h, count, joined = shingles(texts[a:b])
                ends = np.cumsum(count).tolist()
                keys = np.array([sketch(h[e - c : e]) for e, c in zip(ends, count.tolist())], U).view(np.int64)
                n = [x.count(b" ") + 1 if x else 0 for x in joined]
                text = [batch["text"].slice(a, b - a)] if with_text else []
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].slice(a, b - a),
                    pa.array(n, pa.int64()),
                    pa.array([hashlib.sha256(x).digest()[:16] for x in joined], pa.binary()),
                    pa.array(count, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, SKETCHES), pa.int32()), pa.array(keys.reshape(-1))),
                    *text,
                ], names=["doc_id", "n_words", "digest", "n_shingles", "sketches", *["text"] * with_text])
                a = b

    return sliced(docs.select("doc_id", "text"), run, FEATURES + ", text string" * with_text)


def aligned(a: list[int], b: list[int], least: float) -> float:
    """Common shingles in order over all, by bit-parallel alignment within the band that similarity least allows.

    An alignment that reaches least leaves out at most (1 - 2 * least / (1 + least)) of both, so it never strays
    further from the diagonal; what both begin and end with is aligned without search.
    """
    total = len(a) + len(b)
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    n = 0
    m = min(len(a), len(b))
    while n < m and a[n] == b[n]:
        n += 1
    k = 0
    while k < m - n and a[-1 - k] == b[-1 - k]:
        k += 1
    x, y = a[n : len(a) - k], b[n : len(b) - k]
    common = n + k
    if x and y:
        band = int(total * (1 - 2 * least / (1 + least))) + 1
        places: dict[int, int] = defaultdict(int)
        for i, s in enumerate(x):
            places[s] |= 1 << i
        full = (1 << len(x)) - 1
        v = full
        for j, s in enumerate(y):
            if hit := places.get(s, 0):
                hit &= (1 << (j + band + 1)) - 1
                if j > band:
                    hit = hit >> (j - band) << (j - band)
                u = v & hit
                v = ((v + u) | (v - u)) & full
        common += len(x) - v.bit_count()
    return common / (total - common)


class Union:
    """Classes of the numbers below n; the least of a class is its root."""

    def __init__(self, n: int):
        self.top = list(range(n))

    def root(self, x: int) -> int:
        while self.top[x] != x:
            self.top[x] = self.top[self.top[x]]
            x = self.top[x]
        return x

    def link(self, x: int, y: int) -> None:
        self.top[max(x, y)] = min(x, y)


def inside(similarity: float):
    """For a block: each document with the least of its class, where that is another one."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc")
        ids = table["doc"].to_numpy()
        h, count, _ = shingles(byte_values(table["text"]))
        n, ends = len(ids), np.cumsum(count)
        _, key = np.unique(h, return_inverse=True)
        order = np.argsort(key, kind="stable")
        who = np.repeat(np.arange(n), count)[order]
        edges = np.searchsorted(key[order], np.arange(key.max(initial=-1) + 2))
        starts, sizes = edges[:-1], np.diff(edges)
        classes = Union(n)
        for i in range(n):
            own = key[ends[i] - count[i] : ends[i]]
            own = own[sizes[own] > 1]
            each = sizes[own]
            # the documents of all its shingles on end
            at = np.repeat(starts[own] - np.cumsum(each) + each, each) + np.arange(each.sum())
            common = np.bincount(who[at], minlength=n)[i + 1 :]
            close = np.flatnonzero((common > 0) & (common >= similarity * (count[i] + count[i + 1 :] - common)))
            mine = None
            for j in (close[np.argsort(-common[close], kind="stable")] + i + 1).tolist():
                x, y = classes.root(i), classes.root(j)
                if x != y:
                    mine = mine or h[ends[i] - count[i] : ends[i]].tolist()
                    if aligned(mine, h[ends[j] - count[j] : ends[j]].tolist(), similarity) >= similarity:
                        classes.link(x, y)
        roots = np.array([classes.root(i) for i in range(n)], np.int64)
        linked = np.flatnonzero(roots != np.arange(n))
        return pa.table({"leader": pa.array(ids[roots[linked]], pa.int64()), "member": pa.array(ids[linked], pa.int64())})

    return run


def between(similarity: float, common: int, most: int):
    """For a bucket, or a part of it with another: pairs of unlike label and block with common sketches; whether some were left for later.

    A pair is given out only in the first bucket that both have. most: pairs of one document with one label.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc")
        doc, label, block, home, size, part, k = (table[c].to_numpy() for c in ("doc", "label", "block", "home", "n_shingles", "part", "k"))
        keys = table["sketches"].combine_chunks()
        keys = np.asarray(keys.flatten()).reshape(-1, SKETCHES)
        kept = ((table["mask"].to_numpy()[:, None] >> np.arange(SKETCHES)) & 1).astype(bool)
        crossed = len(table) and (part.min() != part.max())
        leader, member, cut = [], [], False
        for i in range(len(doc) - 1):
            rest = slice(i + 1, None)
            ok = (label[rest] != label[i]) & (block[rest] != block[i]) & (home[rest] != doc[i]) & (doc[rest] != home[i])
            ok &= np.minimum(size[rest], size[i]) >= similarity * np.maximum(size[rest], size[i])
            if crossed:
                ok &= part[rest] != part[i]
            j = np.flatnonzero(ok) + i + 1
            if not len(j):
                continue
            equal = keys[j] == keys[i]
            n = equal.sum(axis=1)
            hit = (n >= common) & ((equal & kept[j] & kept[i]).argmax(axis=1) == k[i])
            j, n = j[hit], n[hit]
            order = np.lexsort((doc[j], -n, label[j]))
            j = j[order]
            new = np.flatnonzero(np.diff(label[j], prepend=~label[j][:1]))
            nth = np.arange(len(j)) - np.repeat(new, np.diff(np.append(new, len(j))))
            cut |= bool((nth >= most).any())
            j = j[nth < most]
            leader.append(np.full(len(j), doc[i]))
            member.append(doc[j])
        none = np.zeros(0, np.int64)
        leader, member = np.concatenate([none, *leader]), np.concatenate([none, *member])
        return pa.table({"leader": pa.array(leader, pa.int64()), "member": pa.array(member, pa.int64()), "cut": pa.array(np.full(len(leader), cut), pa.bool_())})

    return run


def verify(similarity: float):
    """For a leader: the members that are aligned enough with it."""

    def run(members: pa.Table, leaders: pa.Table) -> pa.Table:
        names = ["leader", "member"]
        if not len(members) or not len(leaders):
            return pa.table([pa.array([], pa.int64())] * 2, names=names)
        texts = byte_values(leaders["lead_text"].slice(0, 1)) + byte_values(members["text"])
        h, count, _ = shingles(texts)
        at = np.cumsum([0, *count.tolist()]).tolist()
        first = np.sort(h[: at[1]])
        own = h[: at[1]].tolist()
        ok = []
        for i in range(1, len(texts)):
            other = h[at[i] : at[i + 1]]
            # labelled shingles are distinct: an alignment never has more than both have
            place = np.minimum(np.searchsorted(first, other), len(first) - 1)
            common = int((first[place] == other).sum()) if len(first) else 0
            enough = common >= similarity * (len(own) + len(other) - common) and common > 0
            ok.append(bool(enough) and aligned(own, other.tolist(), similarity) >= similarity)
        return members.select(names).filter(pa.array(ok, pa.bool_()))

    return run


def links(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (leader, member) that are aligned enough. A leader's members are dealt over groups of bounded size."""
    sizes = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("n"))
    dealt = pairs.join(sizes, "leader").select("leader", "member", F.pmod(F.xxhash64("member"), F.ceil(F.col("n") / GROUP)).alias("part"))
    members = dealt.join(texts.withColumnRenamed("doc", "member"), "member")
    leaders = dealt.select("leader", "part").distinct().join(texts.withColumnRenamed("doc", "leader"), "leader")
    leaders = leaders.select(F.col("leader").alias("of"), F.col("part").alias("group"), F.col("text").alias("lead_text"))
    near = members.groupBy("leader", "part").cogroup(leaders.groupBy("of", "group")).applyInArrow(verify(similarity), "leader long, member long")
    return materialize(near, "links")


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """node and label (the least node of its component) of undirected edges (leader, member); empty without edges."""
    if edges.limit(task_edges + 1).count() <= task_edges:
        return materialize(edges.coalesce(1).mapInArrow(closed, "node long, label long"), "labels")
    both = edges.select(F.col("leader").alias("a"), F.col("member").alias("b"))
    both = materialize(both.unionAll(both.select("b", "a")), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("other"))
        low = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = materialize(low.join(jump, "label").select("node", "old", F.least("label", "next").alias("label")), "labels")
        if not new.filter("label < old").limit(1).count():
            return labels
        labels = new.select("node", "label")


def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of all edges of a task."""
    edges = [np.stack([batch["leader"].to_numpy(), batch["member"].to_numpy()]) for batch in batches]
    if edges:
        nodes, at = np.unique(np.concatenate(edges, axis=1), return_inverse=True)
        classes = Union(len(nodes))
        for x, y in at.reshape(2, -1).T.tolist():
            x, y = classes.root(x), classes.root(y)
            if x != y:
                classes.link(x, y)
        label = nodes[[classes.root(i) for i in range(len(nodes))]]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(label, pa.int64())], names=["node", "label"])


def candidates(single: DataFrame, common: int) -> DataFrame:
    """doc, n_shingles, sketches, kept (its rarest shared buckets with their sketch's number) and their mask.

    Documents with under `common` shared buckets have no partner. single: doc, n_shingles, sketches.
    """
    buckets = single.select("doc", F.posexplode("sketches").alias("k", "v")).select("doc", "k", F.xxhash64("k", "v").alias("bucket"))
    counts = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    own = buckets.join(counts, "bucket").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("n", "bucket", "k"))).alias("kept"))
    own = own.filter(F.size("kept") >= common).select("doc", F.expr(f"slice(kept, 1, size(kept) - {common - 1})").alias("kept"))
    mask = F.expr("aggregate(kept, 0L, (m, x) -> m | shiftleft(1L, x.k))").alias("mask")
    return materialize(own.join(single, "doc").select("doc", "n_shingles", "sketches", "kept", mask), "buckets")


def homes(every: DataFrame, similarity: float, common: int, block_docs: int) -> DataFrame:
    """doc, home, part: the least leader of a bucket that has enough in common with a document; none for those without."""
    flat = every.select("doc", F.explode("kept.bucket").alias("bucket"))
    leaders = flat.groupBy("bucket").agg(F.min("doc").alias("home"), F.max("doc").alias("hi")).filter("home < hi").select("bucket", "home")
    pairs = flat.join(leaders, "bucket").filter("doc <> home").select("doc", "home").distinct()
    mine = every.select("doc", "n_shingles", "sketches")
    theirs = every.select(F.col("doc").alias("home"), F.col("n_shingles").alias("m"), F.col("sketches").alias("others"))
    equal = F.expr("aggregate(zip_with(sketches, others, (x, y) -> int(x = y)), 0, (s, x) -> s + x)")
    near = F.least("n_shingles", "m") >= similarity * F.greatest("n_shingles", "m")
    pairs = pairs.join(mine, "doc").join(theirs, "home").filter(near & (equal >= common))
    home = materialize(pairs.groupBy("doc").agg(F.min("home").alias("home"), F.first("n_shingles").alias("n_shingles")), "homes")
    parts = F.ceil(F.greatest(F.sum("n_shingles") / BLOCK_SHINGLES, F.count(F.lit(1)) / block_docs)).alias("parts")
    return home.join(home.groupBy("home").agg(parts), "home").select("doc", "home", F.pmod(F.xxhash64("doc"), "parts").alias("part"))


def classes(docs: DataFrame, similarity: float = SIMILARITY, block_docs: int = BLOCK_DOCS, first_pairs: int = FIRST_PAIRS, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """The near-duplicate class of each document: one row per row of docs.

    docs: doc_id, text (more columns are ignored). Words are runs of letters, digits and characters above ASCII, A-Z
    lower-cased. Returns doc_id, n_words, copy_of (the least doc_id with equal words) and class_id (the least doc_id
    of the class). Two documents are linked if their 5-word shingles, aligned in order, are to `similarity` the same
    (a text of under five words is one shingle); classes are the closure. Documents without words are each their own
    class. Rows with one doc_id are one document. A null doc_id has no class of its own: it gets the class of equal
    words, else null. The other parameters bound what one task holds; they don't change the classes.
    """
    return _classes(materialize(features(docs), "sketches"), docs, similarity, block_docs, first_pairs, bucket_docs)


def _classes(rows: DataFrame, docs: DataFrame, similarity: float, block_docs: int = BLOCK_DOCS, first_pairs: int = FIRST_PAIRS, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    common = shared_at_least(similarity)
    single = rows.filter("n_words > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n_shingles"), F.first("sketches").alias("sketches"))
    single = materialize(single, "words")
    every = candidates(single, common)
    some, _ = sieved(docs.select("doc_id", "text"), every.select("doc"))
    texts = some.withColumnRenamed("doc_id", "doc").join(every.select("doc"), "doc").dropDuplicates(["doc"])
    texts = materialize(texts, "texts")
    member = materialize(homes(every, similarity, common, block_docs), "members")
    heads = member.select(F.col("home").alias("doc"), "home", "part").distinct()
    edges = member.unionAll(heads).join(texts, "doc").groupBy("home", "part").applyInArrow(trimmed(inside(similarity)), "leader long, member long")
    edges = materialize(edges, "links")
    label = components(edges)
    own = member.select("doc", "home", F.xxhash64("home", "part").alias("block"))
    seen, most = None, first_pairs
    while True:
        state = every.join(own, "doc", "left").join(label.withColumnRenamed("node", "doc"), "doc", "left")
        state = state.select("doc", F.coalesce("label", "doc").alias("label"), F.coalesce("home", "doc").alias("home"), F.coalesce("block", F.xxhash64("doc")).alias("block"), "n_shingles", "sketches", "mask", "kept")
        flat = state.select("doc", "label", "block", F.explode("kept").alias("x")).select("doc", "label", "block", "x.bucket", "x.k")
        several = flat.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.min("block").alias("c"), F.max("block").alias("d"), F.ceil(F.count(F.lit(1)) / bucket_docs).alias("parts"))
        met = flat.select("doc", "bucket", "k").join(several.filter("a < b AND c < d").select("bucket", "parts"), "bucket").join(state.drop("kept"), "doc").withColumn("part", F.pmod(F.xxhash64("doc"), "parts"))
        met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        met = met.select("doc", "label", "home", "block", "n_shingles", "sketches", "mask", "k", "part", "bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
        new = materialize(met.groupBy("bucket", "i", "j").applyInArrow(between(similarity, common, most), "leader long, member long, cut boolean"), "pairs")
        pairs = new.select("leader", "member")
        if seen is not None:
            pairs = materialize(pairs.join(seen, ["leader", "member"], "left_anti"), "pairs")
        if pairs.limit(1).count():
            edges = edges.unionAll(links(pairs, texts, similarity))
            label = components(edges)
        if not new.filter("cut").limit(1).count():
            break
        seen, most = pairs if seen is None else seen.unionAll(pairs), most * 8
    copies = rows.join(single.select("digest", F.col("doc").alias("copy_of")), "digest", "left").join(label.select(F.col("node").alias("copy_of"), "label"), "copy_of", "left")
    own = F.when(F.col("n_words") > 0, F.col("copy_of")).otherwise(F.col("doc_id"))
    return copies.select("doc_id", "n_words", own.alias("copy_of"), F.coalesce("label", own).alias("class_id"))


def first_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, with all its columns: a row with the least doc_id of the class.

    Of repeated rows (of one doc_id) one stays. Of the rows with a null doc_id and equal words one stays, if no document
    with an id has them; those without words all stay.
    """
    rows = materialize(features(docs), "sketches")
    label = materialize(_classes(rows, docs, similarity).select("doc_id", "class_id"), "classes")
    gone = materialize(label.filter("doc_id <> class_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    some, left = sieved(docs, gone)
    left = left.unionAll(some.join(gone, some["doc_id"] == gone["__gone"], "left_anti"))
    again = label.filter("doc_id = class_id").groupBy(F.col("doc_id").alias("__again")).count().filter("count > 1").select("__again")
    if again.limit(1).count():
        once = docs.join(again, docs["doc_id"] == again["__again"], "left_semi").dropDuplicates(["doc_id"])
        left = left.join(again, left["doc_id"] == again["__again"], "left_anti").unionAll(once)
    if label.filter("doc_id IS NULL").limit(1).count():
        nulls = docs.filter("doc_id IS NULL")
        worded = materialize(features(nulls.select("doc_id", "text").distinct(), with_text=True).filter("n_words > 0").select("digest", "text"), "nulls")
        new = worded.join(rows.filter("doc_id IS NOT NULL").select("digest"), "digest", "left_anti").dropDuplicates(["digest"]).select(F.col("text").alias("__text"))
        worded = worded.select(F.col("text").alias("__text"))
        left = left.filter("doc_id IS NOT NULL").unionAll(nulls.join(new, nulls["text"] == new["__text"], "left_semi").dropDuplicates(["text"]))
        left = left.unionAll(nulls.join(worded, nulls["text"] == worded["__text"], "left_anti"))
    return left


def query(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
