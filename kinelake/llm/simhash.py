"""SimHash near-duplicates: fingerprints, Hamming links found through BK-trees, components.

Links join fingerprints that differ in at most two bits. The 64 bits are cut into four blocks of 16. Two differences
touch at most two blocks, so each link agrees on two whole blocks: the fingerprints are dealt to six shards, one for
each pair of blocks, and a shard is all fingerprints with the same values there. A shard that holds more than
``SHARD`` fingerprints is dealt again by the same rule on its remaining 32 bits (four blocks of 8), and then on the
remaining 16 (four blocks of 4). The last level leaves 8 free bits, so 256 fingerprints are a proven bound, whatever
the data; no group of near copies is ever held by one task, capped or compared pair by pair.

Each shard is a BK-tree: a child hangs below its parent on an edge named by their integer Hamming distance, and a
search follows the edges within the radius only. Trees and the fingerprints that search them share the shard key, so
the bounded tree goes to its searches by that key rather than by a broadcast of unknown size.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinelake.llm import resemble
from kinelake.llm.common import components, query, table, texts_of, whole_text
from kinelake.sources.store import reliable

RADIUS = 2
WORDS = 3
#: Fingerprints in one BK-tree; larger shards are dealt again on further bits.
SHARD = 1024
#: Width of the four blocks at each level, and how many bits stay free below the last.
LEVELS = (16, 8, 4)


def fingerprint(text: str, words: int = WORDS) -> int:
    """64-bit SimHash of a whole text, as a signed long. No word: 0. Fewer words than a shingle: the whole sequence."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    last = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    # In blocks, so that the memory of a very long text stays bounded.
    for at in range(0, n, 1 << 16):
        spans = zip(starts[at : at + (1 << 16)].tolist(), last[at : at + (1 << 16)].tolist())
        h = np.array([digest(joined[a:b], 42) for a, b in spans], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in texts_of(b)], pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; texts are read once and never shuffled."""
    return whole_text(docs).mapInArrow(_fingerprints, "doc_id long, fp long")


class BKTree:
    """Fingerprints as nodes; ``children[i]`` maps a Hamming distance to the child below that edge."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Insert and return the node; an equal value is the node that is there."""
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return 0
        at = 0
        while True:
            d = (self.values[at] ^ value).bit_count()
            if d == 0:
                return at
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return len(self.values) - 1
            at = below

    def within(self, value: int, radius: int) -> list[int]:
        """Nodes at most ``radius`` away: only edges from d - radius to d + radius can lead to one."""
        if not self.values:
            return []
        found, stack = [], [0]
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            for edge, below in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    stack.append(below)
        return found


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """For one shard: (value, smallest value of its group) for every value that is not the smallest itself."""
    tree, parent = BKTree(), list(range(len(values)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, v in enumerate(values):  # sorted and distinct: node i is value i
        for j in tree.within(v, radius):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
        tree.add(v)
    return [(v, values[find(i)]) for i, v in enumerate(values) if find(i) != i]


def _linked(radius):
    mask = (1 << 64) - 1

    def run(batches):
        """Batches sorted by (shard, fp): consecutive rows are a shard, which may go on in the next batch."""
        key, values = None, []

        def close():
            return shard_links(values, radius) if len(values) > 1 else []

        for b in batches:
            out = []
            for k, fp in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != key:
                    out += close()
                    key, values = k, []
                if not values or values[-1] != fp & mask:  # twice only if two shards share a hash
                    values.append(fp & mask)
            if out:
                yield pairs(out)
        if out := close():
            yield pairs(out)

    def pairs(out):
        x = np.array(out, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])

    return run


def _deal(fps: DataFrame, level: int) -> DataFrame:
    """Each row to six shards: by two of the four blocks of the bits that are still free (column ``free``)."""
    width = LEVELS[level]
    rows = [F.struct(F.lit(p).alias("p"), x.alias("free"), y.alias("same")) for p, (x, y) in enumerate(_parts(width))]
    cut = fps.select("shard", "fp", F.explode(F.array(*rows)).alias("r"))
    return cut.select(F.xxhash64("shard", "r.p", "r.same").alias("shard"), "fp", F.col("r.free").alias("free"))


def _parts(width: int):
    """(free bits, equal bits) of column ``free`` for each choice of two equal blocks out of four."""
    free, mask = F.col("free"), (1 << width) - 1

    def block(i):
        return F.shiftrightunsigned(free, i * width).bitwiseAND(F.lit(mask).cast("long"))

    for i, j in combinations(range(4), 2):
        k, m = (x for x in range(4) if x not in (i, j))
        yield F.shiftleft(block(m), width).bitwiseOR(block(k)), F.shiftleft(block(j), width).bitwiseOR(block(i))


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, b the smallest (unsigned) of a's group in a shard.

    ``fps`` has one row per distinct fingerprint in column fp. Inside a shard the edges are stars of the groups the
    tree search joined, so their number is linear in the fingerprints, while every link is within some star. The
    shard key is a 64-bit hash of the equal bits: should two shards share it, they are searched together, which
    changes no link.
    """
    if radius != 2:
        raise ValueError("blocks are cut for a radius of 2")
    rows = fps.select(F.lit(0).cast("long").alias("shard"), "fp", F.col("fp").alias("free"))
    found = None
    for level in range(len(LEVELS)):
        rows = _deal(rows, level)
        sizes = rows.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1")
        sized = rows.join(sizes, "shard")
        last = level == len(LEVELS) - 1
        search = sized if last else sized.filter(F.col("n") <= shard)
        dealt = search.select("shard", "fp").repartition("shard").sortWithinPartitions("shard", "fp")
        edges = dealt.mapInArrow(_linked(radius), "a long, b long")
        found = edges if found is None else found.union(edges)
        if last:
            break
        rows = reliable(sized.filter(F.col("n") > shard).select("shard", "fp", "free"))
        if rows.isEmpty():
            break
    return found


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Every row of ``docs`` with its fingerprint and component: doc_id, fp (long), component_id.

    Equal fingerprints are one node, so copies are never compared. component_id is the smallest doc_id reachable over
    links of at most ``radius`` bits. Null texts count as empty, empty texts have fingerprint 0 and link like others,
    repeated rows stay, null ids never become a component's name unless it has no other; an empty table gives none.
    """
    fps = reliable(fingerprints(docs))
    classes = reliable(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # Edges repeat over shards and levels; components() drops repeats first.
    roots = components(links(classes.select("fp"), radius))
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(named.join(names, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _described(words):
    def run(batches):
        for b in batches:
            texts = texts_of(b)
            sets = [resemble.shingles(t, words) for t in texts]
            cols = [b.column(0), b.column(1), pa.array([fingerprint(t) for t in texts], pa.int64()), pa.array([resemble.node_of(x) for x in sets], pa.int64())]
            cols += [pa.array([len(x) for x in sets], pa.int64()), pa.array([resemble.bands(x) for x in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "no", "fp", "node", "n", "bands"])

    return run


def near_copies(docs: DataFrame, radius: int = RADIUS, words: int = resemble.WORDS, similarity: float = resemble.SIMILARITY) -> DataFrame:
    """Every row of ``docs`` with its component's smallest row: doc_id, no (hash of the text), lead (null, doc_id, no).

    Two rows are linked if their fingerprints differ in at most ``radius`` bits or if their sets of shingles of
    ``words`` words have a Jaccard similarity of at least ``similarity``, confirmed on the whole sets.
    """
    texts = whole_text(docs).select("doc_id", F.xxhash64("text").alias("no"), "text")
    rows = reliable(texts.mapInArrow(_described(words), "doc_id long, no long, fp long, node long, n long, bands array<long>"))
    name = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "no")
    nodes = reliable(rows.groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.min(name).alias("least")))
    # A fingerprint is stood for by its smallest node.
    fps = reliable(rows.select("fp", "node").distinct())
    stands = reliable(fps.groupBy("fp").agg(F.min("node").alias("stand")))
    known = fps.join(stands, "fp").filter("node <> stand").select(F.col("node").alias("a"), F.col("stand").alias("b"))
    near = links(stands.select("fp"), radius).distinct()
    near = near.join(stands.toDF("a", "sa"), "a").join(stands.toDF("b", "sb"), "b").select(F.col("sa").alias("a"), F.col("sb").alias("b"))
    known = reliable(known.union(near))
    named = nodes.select("node", F.col("least.doc_id").alias("id"), F.col("least.no").alias("at"))
    # Rows with one name have one text, so a node may be told more than once.
    whole = texts.join(named, (F.col("no") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("id")))
    edges = resemble.similar(nodes.select("node", "n", "bands"), whole.select("node", "text"), known, words, similarity)
    roots = components(edges).withColumnRenamed("node", "of")
    rooted = nodes.join(roots, nodes["node"] == roots["of"], "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    leads = rooted.groupBy("root").agg(F.min("least").alias("lead"))
    return rows.select("doc_id", "no", "node").join(rooted.join(leads, "root").select("node", "lead"), "node").select("doc_id", "no", "lead")


def keep_one(docs: DataFrame, radius: int = RADIUS, words: int = resemble.WORDS, similarity: float = resemble.SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, that lead their component: the smallest (doc_id, hash of the text), null ids
    last; of rows with the same doc_id and text one stays. Rows of one doc_id with different texts are told apart."""
    found = near_copies(docs, radius, words, similarity)
    lead = found.filter(F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("no") == F.col("lead.no")))
    lead = lead.select(F.col("doc_id").alias("__id"), F.col("no").alias("__no")).distinct()
    named = docs.withColumn("__at", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    kept = named.join(lead, (F.col("__at") == F.col("__no")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left_semi")
    order = Window.partitionBy("doc_id", "__at").orderBy(F.col("text").asc_nulls_first())
    return kept.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n", "__at")


@query("op10_simhash_near_duplicates")
def op10(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
