"""SimHash near-duplicates: majority fingerprints, BK-trees over shards, components of the links.

A shard holds the fingerprints that agree in six of eight bytes. Two fingerprints at most two bits apart differ
in at most two bytes, so they meet in at least one of the 28 shards of each; and a shard has at most 2**16
different fingerprints, which bounds its tree. Trees travel to the tasks with their shard's rows, never through
the driver. Equal fingerprints are one point, so copies cost nothing after the first aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.llm.common import added, blank, dropped, octets, written

SEED = 42
# Elements of a search frontier held at a time.
FRONTIER = 2_000_000


class BKTree:
    """Children are keyed by their Hamming distance to the parent; built and searched a level at a time."""

    def __init__(self, points: np.ndarray):
        """``points``: different 64-bit values; the first is the root."""
        self.points = points
        items = np.arange(1, len(points))
        at = np.zeros(len(items), np.int64)
        parent, edge, child = [], [], []
        while len(items):
            d = np.bitwise_count(points[items] ^ points[at]).astype(np.int64)
            key = at * 65 + d
            _, head, group = np.unique(key, return_index=True, return_inverse=True)
            parent.append(at[head])
            edge.append(d[head])
            child.append(items[head])
            rest = np.ones(len(items), bool)
            rest[head] = False
            items, at = items[rest], items[head][group][rest]
        if parent:
            p, e, c = (np.concatenate(x) for x in (parent, edge, child))
            order = np.argsort(p * 65 + e, kind="stable")
            self.edges, self.children = (p * 65 + e)[order], c[order]
        else:
            self.edges = self.children = np.empty(0, np.int64)

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (query index, point index) at ``radius`` or less; only edges within it are followed."""
        block = max(1, FRONTIER // max(1, len(self.points)))
        for low in range(0, len(queries), block):
            q = np.arange(low, min(low + block, len(queries)))
            node = np.zeros(len(q), np.int64)
            while len(q):
                d = np.bitwise_count(queries[q] ^ self.points[node]).astype(np.int64)
                near = d <= radius
                yield q[near], node[near]
                first = np.searchsorted(self.edges, node * 65 + np.maximum(d - radius, 0), "left")
                last = np.searchsorted(self.edges, node * 65 + np.minimum(d + radius, 64), "right")
                count = last - first
                total = np.cumsum(count)
                q = np.repeat(q, count)
                node = self.children[np.arange(len(q)) - np.repeat(total - count, count) + np.repeat(first, count)]


def local_roots(points: np.ndarray, radius: int) -> np.ndarray:
    """For each point the smallest index it reaches over links of at most ``radius`` bits."""
    root = np.arange(len(points))
    tree = BKTree(points)
    links = [(a[a > b], b[a > b]) for a, b in tree.search(points, radius)]
    a = np.concatenate([x for x, _ in links])
    b = np.concatenate([x for _, x in links])
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words, repeats included; of all words if there are fewer."""
    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    start = np.concatenate(([0], np.cumsum(size)))
    n = max(1, len(parts) - words + 1)
    last = start[np.minimum(np.arange(n) + words, len(parts))] - 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(start[:n].tolist(), last.tolist())), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes, as a signed 64-bit number; 0 for none."""
    ones = np.zeros(64, np.int64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    for low in range(0, len(bits), 255):  # byte-wide sums don't overflow
        ones += np.add.reduce(bits[low:low + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row (id, fp) per row of ``docs``; a null or blank text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [majority(shingle_hashes(t, words)) for t in octets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, fp long")


def _masks() -> list[int]:
    """Six of eight bytes, every choice, as signed 64-bit numbers."""
    out = []
    for a, b in combinations(range(8), 2):
        mask = ((1 << 64) - 1) ^ (0xFF << 8 * a) ^ (0xFF << 8 * b)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def fingerprint_links(points: DataFrame, radius: int = 2) -> DataFrame:
    """Links (u, v), v < u, that connect all of ``points.fp`` (different values) at most ``radius`` bits apart.

    At most one link per point and shard: the components are those of all links, pairs are not listed.
    """
    if not 0 <= radius <= 2:
        raise ValueError("shards are exact for a radius of 0 to 2 bits")
    sharded = points.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _masks()])).alias("shard", "key"))

    def links(shard: np.ndarray, key: np.ndarray, fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        cut = np.flatnonzero((np.diff(shard) != 0) | (np.diff(key) != 0)) + 1
        first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(fp)]))
        out = []
        for i in np.flatnonzero(last - first > 1):
            part = np.sort(fp[first[i]:last[i]])
            root = local_roots(part.view(np.uint64), radius)
            linked = root != np.arange(len(root))
            out.append((part[linked], part[root[linked]]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate((h, c.to_numpy())) for h, c in zip(held, batch.columns)]
            # The last shard may go on in the next batch.
            done = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            cut = done[-1] + 1 if len(done) else 0
            yield from _link_batch(links(*[h[:cut] for h in held]) if cut else [])
            held = [h[cut:] for h in held]
        if len(held[0]):
            yield from _link_batch(links(*held))

    return (sharded.select(F.col("shard").cast("long").alias("shard"), "key", "fp")
            .repartition("shard", "key").sortWithinPartitions("shard", "key")
            .mapInArrow(run, "u long, v long").distinct())


def _link_batch(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if found:
        u, v = (np.concatenate(x) for x in zip(*found))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _contracted(links: DataFrame) -> DataFrame:
    """Links (u, v), v < u, with the components of ``links``: within each partition every node is linked to the smallest it
    reaches there, so that a partition has no more links than nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        u, v = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*held) if held else ((), ())))
        nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
        a, b = ends[:len(u)], ends[len(u):]
        root = np.arange(len(nodes))
        while True:
            # Roots of linked nodes are hooked to the smaller one, then paths are halved.
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            apart = low < high
            if not apart.any():
                break
            np.minimum.at(root, high[apart], low[apart])
            while (root != root[root]).any():
                root = root[root]
        out = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(nodes[root[out]])], ["u", "v"])

    return links.select("u", "v").mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (u, v) with another one: root is the smallest node of its component.

    Links are contracted within partitions; then large-star and small-star steps hook the neighbours of a node to the
    smallest of them, and so on until every node has one link, to a root. The number of steps grows with the logarithm
    of the longest chain; no node's neighbours are gathered.
    """
    edges = written(_contracted(links.where("u <> v")), "links")
    while True:
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
            edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        if ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or out > 0 and into > 0").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        old, edges = edges, written(_contracted(small), "links")
        dropped(old)


def near_duplicate_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2,
) -> DataFrame:
    """(id, fp, component_id) per row: component_id is the smallest id reachable over links of ``radius`` bits.

    Null and blank texts share fingerprint 0 and link like any other. Rows with a null id are kept and linked,
    but give no component id; it is null where a component has null ids only. Repeated rows stay repeated.
    Other columns of ``docs`` are not read, so their names may clash with anything.
    """
    prints = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    points = prints.groupBy("fp").agg(F.min("id").alias("first"))
    stars = components(fingerprint_links(points.select("fp"), radius))
    roots = (points.join(stars, points.fp == stars.node, "left")
             .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(roots.join(least, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


# Samples of shingles that texts are compared by, and shingles in a sample: texts with a Jaccard similarity of 0.8
# agree in one of them with probability 1 - (1 - 0.8 ** 3) ** 10 = 0.999.
SAMPLES, SAMPLE_SIZE = 10, 3


def sample_prints(hashes: np.ndarray, samples: int = SAMPLES, size: int = SAMPLE_SIZE) -> list[int]:
    """SimHash of each of several consistent samples: the shingles whose hash is smallest after a seeded shuffle."""
    out = []
    for i in range(samples):
        order = (hashes ^ np.uint64((0x632BE59BD9B4E019 * (i + 1)) & ((1 << 64) - 1))) * np.uint64(0xD1342543DE82EF95)
        order ^= order >> np.uint64(29)
        part = hashes if len(hashes) <= size else hashes[np.argpartition(order, size)[:size]]
        out.append(majority(np.sort(part)) if len(part) else 0)
    return out


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
    similarity: float = 0.8, radius: int = 2,
) -> DataFrame:
    """(node, root) of different texts: texts of a group are linked by a Jaccard similarity of their shingle sets.

    A node is xxhash64 of a text; texts without a similar one are left out. First groups come from fingerprints that BK-trees
    find near, and from texts that share a whole fingerprint or that of one of ``SAMPLES`` shingle samples: each is
    compared with the first one of every such bucket. Then a prefix filter finds every similar pair of different
    groups, whatever bucket it is in. Every candidate pair is checked on the whole sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, some = [], []
            for t in octets(batch.column(1)):
                h = shingle_hashes(t, words)
                whole.append(majority(h))
                some.append(sample_prints(np.unique(h)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(whole, pa.int64()), pa.array(some, pa.list_(pa.int64()))],
                ["node", "fp", "samples"])

    texts = docs.select(F.xxhash64(blank(F.col(text_col))).alias("node"), blank(F.col(text_col)).alias("text"))
    prints = written(texts.mapInArrow(run, "node long, fp long, samples array<long>")
                     .groupBy("node").agg(F.first("fp").alias("fp"), F.first("samples").alias("samples")), "prints")
    pairs = written(_first_pairs(prints, radius), "pairs")
    sets = _sets(texts, pairs, words)
    links = _alike(pairs, sets, similarity)
    prefixes = written(_prefixes(texts, words, similarity), "prefixes")
    # Texts without words have no shingle to meet by.
    wordless = prefixes.where("n = 0").select("node")
    links = links.unionByName(wordless.select(F.col("node").alias("u")).crossJoin(wordless.agg(F.min("node").alias("v"))).where("u <> v"))
    groups = components(links)
    for used in (prints, pairs, sets):
        dropped(used)
    pairs = written(_prefix_pairs(prefixes, groups, similarity), "pairs")
    sets = _sets(texts, pairs, words)
    more = _alike(pairs, sets, similarity)
    found = components(groups.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    for used in (prefixes, pairs, sets):
        dropped(used)
    return found


def _first_pairs(prints: DataFrame, radius: int) -> DataFrame:
    """(a, b): every node with the smallest node of each bucket it is in, and the smallest nodes of near fingerprints."""
    keys = prints.select("node", F.posexplode(F.concat(F.array("fp"), "samples")).alias("view", "key"))
    firsts = written(keys.groupBy("view", "key").agg(F.min("node").alias("first"), F.count("*").alias("rows")), "firsts")
    shared = keys.join(firsts.where("rows > 1").drop("rows"), ["view", "key"]).where("node <> first")
    of = firsts.where("view = 0").select(F.col("key").alias("fp"), "first")
    near = (fingerprint_links(of.select("fp"), radius)
            .join(of.select(F.col("fp").alias("u"), F.col("first").alias("node")), "u")
            .join(of.select(F.col("fp").alias("v"), "first"), "v"))
    pairs = shared.select("node", "first").unionByName(near.select("node", "first"))
    return pairs.select(F.greatest("node", "first").alias("a"), F.least("node", "first").alias("b")).distinct()


# Slots of 64 bits that tell which texts are surely not wanted, by their hash.
SLOTS = 1 << 17


def _sets(texts: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the texts in pairs (a, b).

    Texts stay where they are: a bitmap of fixed size rules most others out before their shingles are cut, and only sets are shuffled.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    bit = F.pmod("node", F.lit(SLOTS * 64))
    slots = wanted.select(F.shiftright(bit, 6).alias("slot"), F.expr(f"shiftleft(1L, int(pmod(node, {SLOTS * 64}) & 63))").alias("bit")) \
        .groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    filled = np.zeros(SLOTS, np.int64)
    filled[slots.column(0).to_numpy()] = slots.column(1).to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy() % (SLOTS * 64)
            some = batch.filter(pa.array((filled[at >> 6] >> (at & 63) & 1).astype(bool)))
            sets = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in octets(some.column(1))]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return written(texts.mapInArrow(run, "node long, shingles array<long>").join(wanted, "node", "left_semi")
                   .dropDuplicates(["node"]), "sets")


# Counters of shingles by their hash; they only order shingles, so that the rare come first.
COUNTERS = 1 << 18
# Rows of a shingle's list that meet in a task at a time, pairs of rows compared at a time, bits of a set's parities.
LIST_ROWS, PAIRS, BITS = 4096, 1 << 18, 1024


def parities(hashes: np.ndarray) -> bytes:
    """For each of ``BITS`` classes of hashes whether it has an odd number of them: sets whose parities differ in d classes differ in
    at least d elements."""
    odd = np.bincount(((hashes >> np.uint64(20)) % np.uint64(BITS)).view(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _prefixes(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, n, bits, tokens): size and parities of a text's shingle set, and its rarest shingles, so many that two sets of the
    similarity share one of them: all are in one order, so the first they share has at most n - ceil(similarity * n) before it."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for t in octets(batch.column(1)):
                np.add.at(out, (np.unique(shingle_hashes(t, words)) % np.uint64(COUNTERS)).view(np.int64), 1)
        yield pa.RecordBatch.from_arrays([pa.array([out.astype(np.float32).tobytes()])], ["m"])

    counts = added(texts.mapInArrow(tally, "m binary"), (COUNTERS,)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bits, tokens = [], [], []
            for t in octets(batch.column(1)):
                h = np.unique(shingle_hashes(t, words))
                order = np.lexsort((h, counts[(h % np.uint64(COUNTERS)).view(np.int64)]))
                sizes.append(len(h))
                bits.append(parities(h))
                tokens.append(h[order[:len(h) - _least(similarity, len(h)) + 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), pa.array(tokens, pa.list_(pa.int64()))],
                ["node", "n", "bits", "tokens"])

    return texts.mapInArrow(run, "node long, n long, bits binary, tokens array<long>").dropDuplicates(["node"])


def _least(share: float, n: int) -> int:
    return int(np.ceil(share * n - 1e-9))


def _prefix_pairs(prefixes: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of different groups that share a shingle of their prefixes, unless its places, their sizes or their parities rule
    the similarity out.

    Sets with ``i`` and ``j`` shingles before the first they share have at most min(n - i, m - j) in common, and need
    share * (n + m) with share = similarity / (1 + similarity); sets whose parities differ in d classes have at most (n + m - d) / 2 in
    common. The rows of a shingle meet in tasks, so that what is ruled out is never a row of a join. A list of more than
    ``LIST_ROWS`` is cut into cells: by bands of sizes, of which similar sets are in one or two that adjoin, and by parts of which
    every two meet; its largest group meets the others only.
    """
    share = similarity / (1 + similarity)
    rows = prefixes.select("node", "n", F.posexplode("tokens").alias("place", "token"))
    early = F.col("n") - F.col("place") >= 2 * share * F.col("n") - 1e-6
    several = (rows.groupBy("token").agg(F.count("*").alias("rows"), F.max(early).alias("early"))
               .where("rows > 1 and early").select("token"))
    met = rows.drop("n").join(written(several, "tokens"), "token")
    of = prefixes.select("node", "n").join(groups, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"))
    met = written(met.join(of, "node"), "met")
    # Rows per group; the largest group is found by its count, and of equal counts by its number.
    lists = (met.groupBy("token", "root").agg(F.count("*").alias("rows"))
             .groupBy("token").agg(F.max(F.struct("rows", "root")).alias("main"), F.sum("rows").alias("rows"), F.count("*").alias("roots"))
             .where("roots > 1").select(
                 "token", F.when(F.col("rows") > LIST_ROWS, F.struct(
                     F.col("main.root").alias("root"), F.ceil(F.col("main.rows") / LIST_ROWS).cast("long").alias("mains"),
                     F.ceil((F.col("rows") - F.col("main.rows")) / LIST_ROWS).cast("long").alias("others"))).alias("cut")))
    met = met.join(written(lists, "lists"), "token")

    def upto(n: Column) -> Column:
        return F.sequence(F.lit(0).cast("long"), n - 1)

    def cell(band: Column, mixed: int, one: Column, two: Column) -> Column:
        return F.shiftleft(F.shiftleft(band * 2 + mixed, 20) + one, 20) + two

    def cells(band: Column) -> Column:
        mains, others = F.col("cut.mains"), F.col("cut.others")
        part = F.pmod(F.xxhash64("node"), F.when(F.col("root") == F.col("cut.root"), mains).otherwise(others))
        return F.when(F.col("root") == F.col("cut.root"), F.transform(upto(others), lambda o: cell(band, 1, part, o))).otherwise(F.concat(
            F.transform(upto(others), lambda o: cell(band, 0, F.least(part, o), F.greatest(part, o))),
            F.transform(upto(mains), lambda m: cell(band, 1, m, part))))

    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.01 / similarity))).cast("long")
    met = met.select("token", "node", "n", "root", "place", F.explode(F.when(
        F.col("cut").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.concat(cells(band), cells(band + 1)))).alias("cell"))
    return (met.join(prefixes.select("node", "bits"), "node")
            .select("token", "cell", "n", "node", "root", "place", "bits")
            .repartition("token", "cell").sortWithinPartitions("token", "cell", "n", "node")
            .mapInArrow(lambda batches: _meetings(batches, similarity), "a long, b long").distinct())


def _meetings(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(a, b) of rows with one (token, cell), which come in order of token, cell and n."""
    held: list[np.ndarray] = [np.empty(0, np.int64)] * 6 + [np.empty((0, BITS // 64), np.uint64)]
    waiting: list[list[np.ndarray]] = []
    count = 0

    def met(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, waiting, count
        held = [np.concatenate(x) for x in zip(held, *waiting)]
        waiting, count = [], 0
        # The last cell may go on in the next batch.
        done = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1])) if len(held[0]) else []
        cut = len(held[0]) if last else done[-1] + 1 if len(done) else 0
        found = list(_cell_pairs([h[:cut] for h in held], similarity))
        held = [h[cut:] for h in held]
        if found:
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        words = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint64).reshape(-1, BITS // 64)
        waiting.append([batch.column(i).to_numpy().astype(np.int64) for i in range(6)] + [words])
        count += len(words)
        if count >= 2 * LIST_ROWS:
            yield from met(False)
    yield from met(True)


def _cell_pairs(rows: list[np.ndarray], similarity: float) -> Iterator[np.ndarray]:
    token, cell, n, node, root, place, bits = rows
    if not len(n):
        return
    share = similarity / (1 + similarity)
    new = np.concatenate(([False], (np.diff(token) != 0) | (np.diff(cell) != 0)))
    # A row meets those after it in its cell whose sets aren't too large; of a similar pair the smaller set has the shingle early.
    base = np.cumsum(new) * (n.max() + 1)
    most = np.minimum(np.floor(n / similarity + 1e-6).astype(np.int64), n.max())
    count = np.searchsorted(base + n, base + most, "right") - np.arange(len(n)) - 1
    count[n - place < 2 * share * n - 1e-6] = 0
    total = np.cumsum(count)
    for low in range(0, int(total[-1]), PAIRS):
        pair = np.arange(low, min(low + PAIRS, int(total[-1])))
        a = np.searchsorted(total, pair, "right")
        b = a + 1 + pair - (total[a] - count[a])
        both = n[a] + n[b]
        near = (root[a] != root[b]) & (np.minimum(n[a] - place[a], n[b] - place[b]) >= share * both - 1e-6)
        a, b, both = a[near], b[near], both[near]
        apart = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
        near = (both - apart) / 2 >= share * both - 1e-6
        x, y = node[a[near]], node[b[near]]
        yield np.stack((np.maximum(x, y), np.minimum(x, y)), axis=1)


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of the pairs (a, b) whose whole shingle sets reach the similarity."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    alike = both.select(F.col("a").alias("u"), F.col("b").alias("v"), common.alias("n"),
                        (F.size("x") + F.size("y") - common).alias("all"))
    # Texts without words have empty sets, and are alike.
    return alike.where((F.col("n") >= F.col("all") * F.lit(similarity)) | (F.col("all") == 0)).select("u", "v")
