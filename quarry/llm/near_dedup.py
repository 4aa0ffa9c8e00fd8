"""Near-duplicate documents: a chosen-path set similarity join on minwise tokens, confirmed on whole sets.

A document is the set of its distinct word shingles (64-bit hashes). ``SIGNATURE`` minwise tokens embed it: coordinates of two
sets agree with a chance equal to their Jaccard similarity. Documents with one set are a class and go on as its smallest id. Joins that
grow with the corpus are merge joins at every size, so that the plan at a small size is that at a large one.

Candidates. In each of ``trees`` independent trees a node selects one of the coordinates, sometimes a second (1 / threshold on
average), and each document in it goes to the child named by its token there. Children with few
documents are compared exhaustively by a 128-bit sketch of the signatures; those with more branch again. A node still crowded at ``depth`` has documents
that share that many tokens: all of it goes on as one candidate group. Groups that share documents are merged (a superset of the true links within them, up to the trees' recall).

Confirmation, on whole sets. A small group is compared exhaustively in memory, leaving out pairs that are known to be
connected. In a large one, pivots are compared with every member; members linked to a pivot are connected by it, and by the triangle inequality
only those whose distance to the pivot is within the link distance of the nearest unlinked member can still link to one: these and the unlinked
go on, without the pivot. After at most ``rounds`` pivots, or one that links few, what is left is joined exactly, but for pairs that one pivot connects already: a member is
written as its differences from the pivot that links most (from the empty set, if none does), the rarest first; two members that link have so few others that
the first difference that they share is among a member's first (100 - percent) / percent of its size, and among the first half of these for one of them. Members that share
such a difference are compared by a map of parities, which never exceeds the true distance, then on whole sets. No link is dropped for the size of a group.

A link has 100 * |A & B| >= percent * |A | B|. Ids are whole numbers, or texts of them; others are an error. Defined results: documents without words (null or empty texts) have no set, link with nothing and are
their own component; with fewer words than a shingle the whole sequence is one; texts are read whole; rows with one id count as one document; a row with a null id links with nothing, has no component and is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop, stage, stage_counting
from ._words import mix, shingle_set, splitmix
from .components import connected_components

SIGNATURE = 64
_A = splitmix(SIGNATURE, 1001) | np.uint64(1)
_B = splitmix(SIGNATURE, 2002)
LEAF = 64  # a node with more documents branches
SMALL_DOCS, SMALL_SHINGLES, SMALL_BYTES = 256, 1 << 20, 16 << 20  # a group within these is compared in memory
BLOCK_DOCS = 128
PAIR_PARTS = 8  # of a document's pairs, before they are dealt to blocks
GAIN = 16  # a group takes another pivot if its last one linked one in so many of its members without a pivot
NODE_DOCS = 2048  # members that share a difference and are compared at once
MAP_BITS = 512


def minwise(s: np.ndarray) -> np.ndarray:
    """The signature of a non-empty set of hashes, as int32."""
    best = np.full(SIGNATURE, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 2048):
        np.minimum(best, (s[at : at + 2048, None] * _A + _B).min(0), out=best)
    return (mix(best) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, bytes, f1, f2: the set's fingerprint, sig, s1, s2: two bits of each coordinate); n = 0: no set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, size, f1, f2, sig, s1, s2 = [], [], [], [], [], [], []
            for t in b.column("text"):
                text = t.as_py()
                s = shingle_set(text, k)
                n.append(len(s))
                size.append(len(text) if text else 0)
                if len(s):
                    m = minwise(s)
                    f1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                    f2.append(int(mix(s + np.uint64(99)).sum(dtype=np.uint64).view(np.int64)))
                    sig.append(m)
                    bits = np.packbits(np.stack([m & 1, m >> 1 & 1]).astype(bool), axis=1).view(np.int64)
                    s1.append(int(bits[0, 0]))
                    s2.append(int(bits[1, 0]))
                else:
                    for x in (f1, f2, sig, s1, s2):
                        x.append(None)
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.list_(pa.int32())), pa.array(s1, pa.int64()), pa.array(s2, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "bytes", "f1", "f2", "sig", "s1", "s2"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, bytes long, f1 long, f2 long, sig array<int>, s1 long, s2 long")


def _runs(batches: Iterator[pa.RecordBatch], key: str, flush: Callable[[pa.Table], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """Calls ``flush`` for runs of whole groups of rows that follow each other with one key."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        if k[0] != last and held:
            if (out := flush(pa.Table.from_batches(held))) is not None:
                yield out
            held = []
        others = np.flatnonzero(k != k[-1])
        cut = int(others[-1]) + 1 if len(others) else 0
        if cut:  # the last group may go on in the next batch
            if (out := flush(pa.Table.from_batches([*held, b.slice(0, cut)]))) is not None:
                yield out
            held = []
        held.append(b.slice(cut))
        last = k[-1]
    if held and (out := flush(pa.Table.from_batches(held))) is not None:
        yield out


def _edges(a: list[int] | np.ndarray, b: list[int] | np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _bounds(keys: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True))


def leaf_edges(rows: DataFrame, threshold: float) -> DataFrame:
    """Candidate edges (a, b) within small nodes: enough of the sketch agrees, and the sizes allow a link.

    Rows: (node, doc_id, n, s1, s2). Only edges that join two parts of a node are given, never all its pairs.
    """
    # agreement of two bits by chance is 1/4; three deviations below the threshold's expectation
    expected = 0.25 + 0.75 * threshold
    least = int(np.floor(SIGNATURE * expected - 3 * np.sqrt(SIGNATURE * expected * (1 - expected))))

    def flush(t: pa.Table) -> pa.RecordBatch | None:
        node, doc, n = (t.column(c).to_numpy() for c in ("node", "doc_id", "n"))
        s1, s2 = (t.column(c).to_numpy().astype(np.uint64) for c in ("s1", "s2"))
        out_a, out_b = [], []
        bounds = _bounds(node)
        pairs = np.array([lo for lo, hi in bounds if hi - lo == 2], dtype=np.int64)
        if len(pairs):  # nodes of two at once
            same = SIGNATURE - np.bitwise_count((s1[pairs] ^ s1[pairs + 1]) | (s2[pairs] ^ s2[pairs + 1])).astype(int)
            ok = (same >= least) & (np.minimum(n[pairs], n[pairs + 1]) >= threshold * np.maximum(n[pairs], n[pairs + 1])) & (doc[pairs] != doc[pairs + 1])
            out_a += doc[pairs[ok]].tolist()
            out_b += doc[pairs[ok] + 1].tolist()
        for lo, hi in bounds:
            if hi - lo < 3:
                continue
            part = np.arange(hi - lo)
            for i in range(hi - lo - 1):
                x = slice(lo + i + 1, hi)
                same = SIGNATURE - np.bitwise_count((s1[x] ^ s1[lo + i]) | (s2[x] ^ s2[lo + i])).astype(int)
                for j in (np.flatnonzero((same >= least) & (np.minimum(n[x], n[lo + i]) >= threshold * np.maximum(n[x], n[lo + i])) & (part[i + 1 :] != part[i])) + i + 1).tolist():
                    if part[j] != part[i] and doc[lo + j] != doc[lo + i]:
                        out_a.append(int(doc[lo + i]))
                        out_b.append(int(doc[lo + j]))
                        part[part == part[j]] = part[i]
        return _edges(out_a, out_b) if out_a else None

    return rows.select("node", "doc_id", "n", "s1", "s2").repartition("node").sortWithinPartitions("node", "doc_id").mapInArrow(lambda it: _runs(it, "node", flush), "a long, b long")


def candidate_edges(reps: DataFrame, threshold: float, trees: int, depth: int, paths: list[str]) -> DataFrame:
    """Candidate edges (a, b) of the classes' representatives (doc_id, n, sig, s1, s2). What ``paths`` gains can go once they have been read.

    A level writes the members of its nodes with the nodes' sizes; the small nodes of all levels are compared in one pass.
    """
    extra = int((1 / threshold - 1) * 1_000_000)
    # the coordinates that a node selects follow from its name: one always, a second so that 1 / threshold are expected
    picked = f"filter(array(pmod(node, {SIGNATURE}), CASE WHEN pmod(xxhash64(node, 5), 1000000) < {extra} THEN pmod(xxhash64(node, 6), {SIGNATURE}) END), i -> i IS NOT NULL)"
    rows = reps.select("doc_id", "n", "sig", "s1", "s2", F.explode(F.expr(f"transform(sequence(1, {trees}), t -> xxhash64('root', t))")).alias("node"))
    small, crowd = None, None
    for level in range(1, depth + 1):
        child = rows.select("doc_id", "n", "s1", "s2", "node", "sig", F.explode(F.expr(f"array_distinct({picked})")).alias("i")).select(
            "doc_id", "n", "s1", "s2", F.expr("xxhash64(node, i, sig[int(i)])").alias("node")
        )
        sizes = child.groupBy("node").agg(F.count("*").alias("k")).filter("k > 1")
        members, path, seen = stage_counting(child.join(sizes.hint("merge"), "node"), "node-members", crowded=F.col("k") > LEAF)
        paths.append(path)
        leaves = members.filter(F.col("k") <= LEAF)
        small = leaves if small is None else small.unionByName(leaves)
        crowded = members.filter(F.col("k") > LEAF)
        if not seen["crowded"]:
            break
        if level == depth:
            least = crowded.groupBy("node").agg(F.min("doc_id").alias("a"))
            crowd = crowded.select("node", F.col("doc_id").alias("b")).join(least, "node").filter("a <> b").select("a", "b")
            break
        # a document's signature is joined once, however many nodes it is in (bounded by the trees and the level)
        nodes = crowded.groupBy("doc_id").agg(F.collect_set("node").alias("nodes"))
        rows = reps.select("doc_id", "n", "sig", "s1", "s2").join(nodes.hint("merge"), "doc_id").select("doc_id", "n", "sig", "s1", "s2", F.explode("nodes").alias("node"))
    edges = leaf_edges(small, threshold)
    return _thinned(edges if crowd is None else edges.union(crowd))


def _thinned(edges: DataFrame) -> DataFrame:
    """Fewer edges with the same components: a document keeps its smallest neighbour, which its other smaller neighbours are joined to instead.

    A document's smaller neighbours are bounded by the nodes it is in and their size.
    """
    down = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u <> v")
    near = down.groupBy("v").agg(F.sort_array(F.collect_set("u")).alias("us"))
    pair = F.explode(F.expr("concat(array(named_struct('a', us[0], 'b', v)), transform(slice(us, 2, size(us)), x -> named_struct('a', us[0], 'b', x)))"))
    return near.select(pair.alias("e")).select("e.a", "e.b")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> tuple[bool, float]:
    """Whether two sets link, and their distance."""
    if not len(a) or not len(b):
        return False, 1.0
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False, 1 - min(len(a), len(b)) / max(len(a), len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return 100 * both >= percent * union, 1 - both / union


def group_edges(ids: list[int], sets: list[np.ndarray], percent: int, left: int | None = None) -> list[tuple[int, int]]:
    """Links that connect the components of a group; with ``left``, only pairs of its first ``left`` members and the others."""
    n = len(ids)
    part = np.arange(n)
    size = np.array([len(s) for s in sets])
    order = np.argsort(ids, kind="stable")
    out = []
    for x, i in enumerate(order.tolist()):
        rest = order[x + 1 :]
        rest = rest[(part[rest] != part[i]) & (100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i]))]
        if left is not None:
            rest = rest[(rest < left) != (i < left)]
        for j in rest.tolist():
            if part[j] != part[i] and _linked(sets[i], sets[j], percent)[0]:
                out.append((ids[i], ids[j]))
                part[part == part[j]] = part[i]
    return out


def small_group_edges(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) within groups that fit in memory. Rows: (grp, doc_id, side, text); sides, if not null, are compared with each other only."""

    def flush(t: pa.Table) -> pa.RecordBatch | None:
        out = []
        grp, doc, side, text = t.column("grp").to_numpy(), t.column("doc_id").to_pylist(), t.column("side").to_pylist(), t.column("text")
        for lo, hi in _bounds(grp):
            order = sorted(range(lo, hi), key=lambda i: (side[i] or 0, doc[i]))
            split = sum(1 for i in order if side[i] == 0) if side[lo] is not None else None
            out += group_edges([doc[i] for i in order], [shingle_set(text[i].as_py(), k) for i in order], percent, split)
        return _edges([a for a, _ in out], [b for _, b in out]) if out else None

    return rows.select("grp", "doc_id", "side", "text").repartition("grp").sortWithinPartitions("grp", "doc_id").mapInArrow(lambda it: _runs(it, "grp", flush), "a long, b long")


def _consensus(sample: DataFrame) -> DataFrame:
    """(grp, t1, t2): of each bit of the sketches in a group's sample the value that most of them have."""

    def flush(t: pa.Table) -> pa.RecordBatch:
        grp, s1, s2 = (t.column(c).to_numpy() for c in ("grp", "s1", "s2"))
        bits = np.unpackbits(np.stack([s1, s2], axis=1).view(np.uint8), axis=1)
        out = [(int(grp[lo]), *np.packbits(2 * bits[lo:hi].sum(0) > hi - lo).view(np.int64).tolist()) for lo, hi in _bounds(grp)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["grp", "t1", "t2"])

    return sample.select("grp", "s1", "s2").repartition("grp").sortWithinPartitions("grp").mapInArrow(lambda it: _runs(it, "grp", flush), "grp long, t1 long, t2 long")


def _pivots(free: DataFrame) -> DataFrame:
    """(grp, pivot): the member whose sketch agrees most with the consensus of at most 64 members; close to what the group was copied from."""
    sample = free.groupBy("grp", F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("b")).agg(F.min_by(F.struct("s1", "s2"), F.xxhash64("doc_id")).alias("x")).select("grp", "x.*")
    differ = F.bit_count(F.col("s1").bitwiseXOR(F.col("t1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("t2")))
    rows = free.join(_consensus(sample), "grp").select("grp", "doc_id", differ.alias("differ"))
    return rows.groupBy("grp").agg(F.min_by("doc_id", F.struct("differ", "doc_id")).alias("pivot"))


def _differences(rows: DataFrame, k: int) -> DataFrame:
    """(grp, doc_id, part, n, map, diff) of (grp, doc_id, part, text, ptext): the set's size, the parities of its hashes dealt to MAP_BITS, and its differences from the pivot's set; what the pivot alone has is written as its complement."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pivot = None, np.empty(0, dtype=np.uint64)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                n, maps, diff = [], [], []
                for text, ptext in zip(b.column("text"), b.column("ptext").to_pylist(), strict=True):
                    if ptext != last:
                        last, pivot = ptext, shingle_set(ptext, k)
                    x = shingle_set(text.as_py(), k)
                    n.append(len(x))
                    maps.append(np.packbits((np.bincount((x % np.uint64(MAP_BITS)).astype(np.int64), minlength=MAP_BITS) & 1).astype(bool)).tobytes())
                    diff.append(np.concatenate([np.setdiff1d(x, pivot, assume_unique=True), ~np.setdiff1d(pivot, x, assume_unique=True)]).view(np.int64))
                cols = [b.column("grp"), b.column("doc_id"), b.column("part"), pa.array(n, pa.int64()), pa.array(maps, pa.binary()), pa.array(diff, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["grp", "doc_id", "part", "n", "map", "diff"])

    return rows.select("grp", "doc_id", "part", "text", "ptext").mapInArrow(run, "grp long, doc_id long, part long, n long, map binary, diff array<long>")


def node_pairs(node: np.ndarray, doc: np.ndarray, n: np.ndarray, part: np.ndarray, first: np.ndarray, side: np.ndarray, maps: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (x, y) of one node, of different parts, that may link: sizes and maps allow it, and one of them at least is marked as first. Rows are sorted by node and n; sides other than 2 are compared with each other only."""
    at = np.arange(len(node))
    for step in range(1, len(node)):
        at = at[at + step < len(node)]
        at = at[(node[at] == node[at + step]) & (percent * n[at + step] <= 100 * n[at])]
        if not len(at):
            return
        x, y = at, at + step
        ok = (first[x] | first[y]) & (part[x] != part[y]) & (doc[x] != doc[y]) & ((side[x] == 2) | (side[x] != side[y]))
        x, y = x[ok], y[ok]
        most = (100 - percent) * (n[x] + n[y]) // (100 + percent)
        ok = np.bitwise_count(maps[x, 0] ^ maps[y, 0]) <= most
        x, y, most = x[ok], y[ok], most[ok]
        ok = np.bitwise_count(maps[x] ^ maps[y]).sum(1, dtype=np.int64) <= most
        if ok.any():
            yield x[ok], y[ok]


def _node_candidates(nodes: DataFrame, percent: int, hubs: bool) -> DataFrame:
    """Pairs (a, b), a < b, with repeats, of members of one node that may link; with ``hubs``, of each row's only the one with the smallest id."""

    def flush(t: pa.Table) -> pa.RecordBatch | None:
        node, doc, n, part, first, side = (t.column(c).to_numpy() for c in ("node", "doc_id", "n", "part", "first", "side"))
        maps = np.frombuffer(b"".join(t.column("map").to_pylist()), dtype=np.uint64).reshape(len(node), -1)
        least, out_a, out_b = doc.copy(), [], []
        for x, y in node_pairs(node, doc, n, part, first, side, maps, percent):
            a, b = np.where(doc[x] < doc[y], x, y), np.where(doc[x] < doc[y], y, x)
            if hubs:
                np.minimum.at(least, b, doc[a])
            else:
                out_a.append(doc[a])
                out_b.append(doc[b])
        if hubs:
            some = least < doc
            out_a, out_b = [least[some]], [doc[some]]
        return _edges(np.concatenate(out_a), np.concatenate(out_b)) if out_a and len(out_a[0]) else None

    rows = nodes.select("node", "doc_id", "n", "part", "first", "side", "map").repartition("node").sortWithinPartitions("node", "n", "doc_id")
    return rows.mapInArrow(lambda it: _runs(it, "node", flush), "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs, which may repeat, that link, on whole sets; a document's pairs are dealt to PAIR_PARTS by a hash, and each part to groups of BLOCK_DOCS."""
    # in order, so that a task that runs again makes the same groups
    held = pairs.groupBy("a", F.pmod(F.xxhash64("b"), F.lit(PAIR_PARTS)).alias("x")).agg(F.sort_array(F.collect_set("b")).alias("bs"))
    blocks = F.posexplode(F.expr(f"transform(sequence(0, int((size(bs) - 1) div {BLOCK_DOCS})), i -> slice(bs, i * {BLOCK_DOCS} + 1, {BLOCK_DOCS}))")).alias("i", "block")
    member = F.explode(F.expr("concat(array(named_struct('doc_id', a, 'side', 0)), transform(block, b -> named_struct('doc_id', b, 'side', 1)))")).alias("m")
    dealt = held.select("a", "x", blocks).select(F.xxhash64("a", "x", "i").alias("grp"), member).select("grp", "m.doc_id", "m.side")
    return small_group_edges(dealt.join(texts, "doc_id"), k, percent)


def _left_edges(left: DataFrame, texts: DataFrame, k: int, percent: int, paths: list[str]) -> DataFrame:
    """Links that connect the components of what the pivots leave, (grp, doc_id, lab); members with one lab are connected already.

    Hubs first: each member is confirmed with the smallest candidate of each of its nodes; of the other candidates those that are in another component then.
    """
    main = left.filter("lab is not null").groupBy("grp", "lab").agg(F.count("*").alias("c")).groupBy("grp").agg(F.max_by("lab", F.struct("c", "lab")).alias("pivot"))
    ptext = main.join(texts.select(F.col("doc_id").alias("pivot"), F.col("text").alias("ptext")), "pivot").select("grp", "ptext")
    rows = left.withColumn("part", F.coalesce("lab", "doc_id")).join(texts, "doc_id").join(ptext, "grp", "left")
    sets, sets_path = stage(_differences(rows, k), "differences")
    each = sets.select("grp", "doc_id", "part", F.explode("diff").alias("d"))
    # differences that no two parts share come first in the order, then by their number; any order that all members have in common is right
    shared = each.groupBy("grp", "d").agg(F.count("*").alias("k"), F.min("part").alias("p"), F.max("part").alias("q")).filter("p <> q").select("grp", "d", "k")
    ranked = each.join(shared, ["grp", "d"]).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("k", "d"))).alias("ds"))
    most = F.floor(F.col("n") * (100 - percent) / percent + 1e-9)
    own = sets.select("grp", "doc_id", "part", "n", "map", most.alias("most"), F.size("diff").alias("m")).join(ranked, "doc_id")
    alone = F.col("m") - F.size("ds")
    heads = own.select("grp", "doc_id", "part", "n", "map", "most", alone.alias("alone"), F.posexplode(F.slice("ds", F.lit(1), F.greatest(F.lit(0), F.col("most") + 1 - alone).cast("int"))).alias("i", "x"))
    nodes = heads.select(F.xxhash64("grp", "x.d").alias("node"), "doc_id", "part", "n", "map", (F.col("alone") + F.col("i") <= F.floor(F.col("most") / 2)).alias("first"))
    sizes = nodes.groupBy("node").agg(F.count("*").alias("k"), F.min("part").alias("p"), F.max("part").alias("q"), F.max("first").alias("any")).filter("p <> q and any")
    # crowded nodes are compared by pairs of blocks
    blocks = nodes.join(sizes.select("node", F.ceil(F.col("k") / NODE_DOCS).cast("int").alias("nb")), "node").withColumn("x", F.pmod(F.xxhash64("doc_id", "node"), "nb").cast("int"))
    blocks = blocks.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    key = F.when(F.col("nb") == 1, F.col("node")).otherwise(F.xxhash64("node", F.least("x", "y"), F.greatest("x", "y")))
    side = F.when(F.col("x") < F.col("y"), 0).when(F.col("x") > F.col("y"), 1).otherwise(2)
    # a block meets itself once, and so is compared within itself there
    keyed, keyed_path = stage(blocks.select(key.alias("node"), "doc_id", "n", "part", "first", side.alias("side"), "map"), "difference-nodes")
    hubs, hubs_path = stage(_confirmed(_node_candidates(keyed, percent, True), texts, k, percent), "hub-links")
    # most members are next to a hub or a pivot; what one round leaves apart is compared, though it may be connected
    known = connected_components(hubs.union(left.filter("lab is not null").select("lab", "doc_id")), rounds=1)
    parted = keyed.join(known.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").withColumn("part", F.coalesce("component", "part")).drop("component")
    paths += [sets_path, keyed_path, hubs_path]
    return _confirmed(_node_candidates(parted, percent, False), texts, k, percent).union(hubs)


def large_group_edges(large: DataFrame, texts: DataFrame, k: int, percent: int, rounds: int, paths: list[str]) -> DataFrame:
    """Links that connect the components within large groups. large: (grp, doc_id, s1, s2); texts: (doc_id, text).

    While more than SMALL_DOCS members of a group have no pivot, and the last pivot linked one in GAIN of them at least, another pivot is compared with all
    that is left of it. In the end what is left is joined by its differences from the pivot with the most members.
    """
    spark = large.sparkSession
    link = 1 - percent / 100
    found: list[DataFrame] = []
    left, left_path = stage(large.withColumns({"lab": F.lit(None).cast("long"), "more": F.lit(True)}), "large-groups")
    paths.append(left_path)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for b in batches:
            linked, far = [], []
            for pivot, ptext, text in zip(b.column("pivot").to_pylist(), b.column("ptext"), b.column("text"), strict=True):
                if pivot not in known:
                    known.clear()
                    known[pivot] = shingle_set(ptext.as_py(), k)
                a, d = _linked(known[pivot], shingle_set(text.as_py(), k), percent)
                linked.append(a)
                far.append(d)
            names = ["grp", "doc_id", "s1", "s2", "lab", "pivot"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(linked, pa.bool_()), pa.array(far, pa.float64())], [*names, "linked", "far"])

    for _ in range(rounds):
        free = left.filter("lab is null and more")
        busy = free.groupBy("grp").agg(F.count("*").alias("k")).filter(F.col("k") > SMALL_DOCS).select("grp")
        p, p_path, seen = stage_counting(_pivots(free.join(busy, "grp")), "pivots", all=F.lit(True))
        if not seen["all"]:
            drop(spark, p_path)
            break
        ptext = p.join(texts.withColumnRenamed("doc_id", "pivot").withColumnRenamed("text", "ptext"), "pivot")
        rows = left.join(texts, "doc_id").join(ptext, "grp").filter("doc_id <> pivot").select("grp", "doc_id", "s1", "s2", "lab", "text", "pivot", "ptext")
        done, done_path = stage(rows.mapInArrow(compare, "grp long, doc_id long, s1 long, s2 long, lab long, pivot long, linked boolean, far double"), "compared")
        found.append(done.filter("linked").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")))
        # where sizes alone forbid a link the distance is a lower bound, which only keeps more
        nearest = done.groupBy("grp").agg(F.min(F.expr("if(linked, null, far)")).alias("near"), F.expr(f"count_if(lab is null and linked) * {GAIN} >= count_if(lab is null)").alias("more"))
        on = done.join(nearest, "grp").filter(f"not linked or far >= near - {link} - 1e-9").select("grp", "doc_id", "s1", "s2", F.when(F.col("lab").isNull() & F.col("linked"), F.col("pivot")).otherwise(F.col("lab")).alias("lab"), "more")
        rest = left.join(p.select("grp"), "grp", "left_anti").select("grp", "doc_id", "s1", "s2", "lab", F.lit(False).alias("more"))
        left, left_path, seen = stage_counting(on.unionByName(rest), "left", free=F.expr("lab is null and more"))
        paths += [done_path, left_path]
        drop(spark, p_path)
        if seen["free"] <= SMALL_DOCS:
            break
    out = _left_edges(left, texts, k, percent, paths)
    for f in found:
        out = out.union(f)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, trees: int = 10, depth: int = 3, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row."""
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    base, _ = stage(signatures(docs, k, id_col, text_col), "signatures")
    first = F.min_by(F.struct("doc_id", "bytes", "sig", "s1", "s2"), "doc_id").alias("x")
    classes, classes_path = stage(base.filter("n > 0 and doc_id is not null").groupBy("n", "f1", "f2").agg(first).select("n", "f1", "f2", "x.*"), "classes")
    paths: list[str] = []
    groups = connected_components(candidate_edges(classes, percent / 100, trees, depth, paths)).select(F.col("id").alias("doc_id"), F.col("component").alias("grp"))
    drop(spark, *paths)
    # a document with several texts, and so several classes, counts each of them
    member = classes.groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.first("s1").alias("s1"), F.first("s2").alias("s2")).join(groups, "doc_id")
    size = member.groupBy("grp").agg(F.count("*").alias("c"), F.sum("n").alias("w"), F.sum("bytes").alias("y"))
    fits = (F.col("c") == 2) | ((F.col("c") <= SMALL_DOCS) & (F.col("w") <= SMALL_SHINGLES) & (F.col("y") <= SMALL_BYTES))
    sized = member.join(size, "grp").select("doc_id", "grp", "s1", "s2", fits.alias("small"))
    # the documents are shuffled once, for the texts of members
    full, full_path, seen = stage_counting(texts.join(sized.hint("merge"), "doc_id").select("grp", "doc_id", "s1", "s2", "small", "text"), "member-texts", large=~F.col("small"))
    paths = [full_path]
    links = small_group_edges(full.filter("small").withColumn("side", F.lit(None).cast("int")), k, percent)
    large = full.filter("not small")
    if seen["large"]:
        more = large_group_edges(large.select("grp", "doc_id", "s1", "s2").distinct(), large.select("doc_id", "text"), k, percent, rounds, paths)
        links = links.union(more)
    label = connected_components(links)
    drop(spark, *paths)
    kept = classes.select("n", "f1", "f2", F.col("doc_id").alias("rep"))
    out = base.select("doc_id", "n", "f1", "f2").join(kept.hint("merge"), ["n", "f1", "f2"], "left").join(label.withColumnRenamed("id", "rep").hint("merge"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
