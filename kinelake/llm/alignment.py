"""Token sequences of two tokenizers aligned on the bytes they share.

A (byte-level BPE) and B (pieces) cut the same bytes differently. Offsets where a token of A and one of B both end cut
the two sequences into groups; within a group every token of A is linked with every token of B. All documents of a
batch are merged in lockstep: one vector holds, for each document, how far A and B have come, and a step moves the
side that is behind, or both where they end together. Such documents emit their group with that step, and finished
documents leave the vector.

How many documents hold a pair of ids linked is a corpus-wide count; a document's links are judged by it. Both are joins
on distinct pairs of a document, not on occurrences.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.common import query, table, texts_of, whole_text
from kinelake.sources.store import scratch_path

#: Pairs that may be sent to every executor; a larger table meets the documents by an exchange.
BROADCAST_PAIRS = 1 << 20
#: Rows in one Arrow batch, and code points that are merged at a time.
ROWS, MERGED = 2048, 2 << 20


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable ones as they are, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Side:
    """One tokenizer: ids of texts, and what each id stands for."""

    def __init__(self, data: dict[int, bytes]):
        size = max(data) + 1
        self.data = np.full(size, b"", object)
        self.size = np.zeros(size, np.int64)
        for i, x in data.items():
            self.data[i], self.size[i] = x, len(x)
        # Decimal ids with the mark that follows them: another id of the same side, or the end of the side's part.
        self.more = np.array([b"%d," % i for i in range(size)], object)
        self.last = np.array([b"%d" % i for i in range(size)], object)


class ByteSide(Side):
    """Byte-level BPE from a tokenizers file; ranks are the vocabulary's ids, strings of special tokens plain text."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        special = {t["content"] for t in spec.get("added_tokens", ())}
        words = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        data = {i: bytes(letters[c] for c in t) for t, i in words.items()}
        self.coder = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={x: i for i, x in data.items()}, special_tokens={})
        super().__init__(data)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.coder.encode_ordinary(" " + t) for t in texts]


class PieceSide(Side):
    """A sentencepiece model; the library itself puts the space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.coder = sentencepiece.SentencePieceProcessor(model_file=path)
        data = {}
        for i in range(self.coder.get_piece_size()):
            piece = self.coder.id_to_piece(i)
            data[i] = bytes([int(piece[3:5], 16)]) if self.coder.is_byte(i) else piece.replace("▁", " ").encode()
        super().__init__(data)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.coder.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def sides(a: str, b: str) -> tuple[ByteSide, PieceSide]:
    return ByteSide(a), PieceSide(b)


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def merge(ends_a: np.ndarray, ends_b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray) -> np.ndarray:
    """Groups of all documents as rows (document, first of A, behind A, first of B, behind B), in order.

    ``ends_a`` and ``ends_b`` are the documents' token ends one after the other, each counted in its document's bytes;
    document d has the tokens from_a[d] to from_a[d + 1] and from_b[d] to from_b[d + 1], and both sides end at its last
    byte.
    """
    doc = np.flatnonzero((np.diff(from_a) > 0) & (np.diff(from_b) > 0))
    a, b, stop = from_a[doc], from_b[doc], from_a[doc + 1]
    out = []
    while doc.size:
        ahead = ends_a[a] - ends_b[b]
        a = a + (ahead <= 0)
        b = b + (ahead >= 0)
        cut = (ahead == 0).nonzero()[0]
        if cut.size:
            reached = a[cut]
            out.append((doc[cut], reached, b[cut]))
            if (reached == stop[cut]).any():
                left = a < stop
                doc, a, b, stop = doc[left], a[left], b[left], stop[left]
    if not out:
        return np.zeros((5, 0), np.int64)
    of, end_a, end_b = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(end_a)  # tokens of A lie in the order of the documents
    of, end_a, end_b = of[order], end_a[order], end_b[order]
    first = np.append(True, of[1:] != of[:-1])
    return np.stack([of, np.where(first, from_a[of], np.roll(end_a, 1)), end_a, np.where(first, from_b[of], np.roll(end_b, 1)), end_b])


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] numbers, then the same for each further run."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    made = pa.array(lists, pa.list_(pa.int32()))
    return made.values.to_numpy().astype(np.int64), made.offsets.to_numpy().astype(np.int64)


def exact(side: Side, ids: np.ndarray, at: np.ndarray, texts: list[str]) -> list[bool]:
    """Whether the tokens' bytes are a space and the text."""
    data = side.data[ids].tolist()
    return [b"".join(data[x:z]) == b" " + t.encode() for x, z, t in zip(at[:-1].tolist(), at[1:].tolist(), texts)]


def align_texts(a: Side, b: Side, texts: list[str]) -> dict[str, list]:
    """For each text n_a, n_b, n_groups, n_links, groups_sha256, and its distinct linked pairs (a << 32 | b) with counts."""
    ids = [side.encode(texts) for side in (a, b)]
    (flat_a, from_a), (flat_b, from_b) = map(flat, ids)
    good = [bool(t) and x and y for t, x, y in zip(texts, exact(a, flat_a, from_a, texts), exact(b, flat_b, from_b, texts))]
    if not all(good):
        ids = [[x if ok else [] for x, ok in zip(found, good)] for found in ids]
        (flat_a, from_a), (flat_b, from_b) = map(flat, ids)
    ends = []
    for side, found, at in ((a, flat_a, from_a), (b, flat_b, from_b)):
        sums = np.concatenate(([0], np.cumsum(side.size[found])))
        ends.append(sums[1:] - np.repeat(sums[at[:-1]], np.diff(at)))
    doc, a0, a1, b0, b1 = merge(*ends, from_a, from_b)
    na, nb = a1 - a0, b1 - b0
    n = len(texts)

    # Ids of A and B in the order of the digest: a group's part of A, then its part of B.
    marks = np.empty(2 * (len(flat_a) + len(flat_b)), object)
    before_a, before_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    for side, found, first, size, start, tail in ((a, flat_a, a0, na, before_a + before_b, b"|"), (b, flat_b, b0, nb, before_a + na + before_b, b";")):
        to, token = runs(start, size), found[runs(first, size)]
        marks[2 * to], marks[2 * to + 1] = side.more[token], b""
        final = start + size - 1
        marks[2 * final], marks[2 * final + 1] = side.last[found[first + size - 1]], tail
    group_from = np.searchsorted(doc, np.arange(n + 1))
    token_from = 2 * np.concatenate((before_a + before_b, [len(flat_a) + len(flat_b)]))[group_from]
    digests = []
    for x, z in zip(token_from[:-1].tolist(), token_from[1:].tolist()):
        digests.append(hashlib.sha256(b"".join(marks[x : z - 1].tolist())).hexdigest() if z > x else "")

    links = na * nb
    each = np.repeat(np.arange(len(doc)), links)
    inside = runs(np.zeros(len(doc), np.int64), links)
    linked_a, linked_b = flat_a[a0[each] + inside // nb[each]], flat_b[b0[each] + inside % nb[each]]
    key = np.sort((doc[each] * len(a.data) + linked_a) * len(b.data) + linked_b)
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(at, len(key)))
    owner, pair = np.divmod(key[at], len(a.data) * len(b.data))
    pair = (pair // len(b.data) << 32) | pair % len(b.data)
    pair_from = np.searchsorted(owner, np.arange(n + 1))
    return {
        "n_a": np.diff(from_a),
        "n_b": np.diff(from_b),
        "n_groups": np.diff(group_from),
        "n_links": np.bincount(doc, links, n).astype(np.int64),
        "groups_sha256": digests,
        "pairs": pa.ListArray.from_arrays(pa.array(pair_from.astype(np.int32)), pa.array(pair)),
        "times": pa.ListArray.from_arrays(pa.array(pair_from.astype(np.int32)), pa.array(times.astype(np.int64))),
    }


ROW = "row_no long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def align(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """One row for each row of ``docs`` with its groups' digest and its distinct linked pairs.

    ``row_no`` tells rows apart within one run of the job, repeated or null ids included. Null and empty texts, and texts
    that a tokenizer does not give back byte for byte, have no tokens: zeros, and an empty digest. An empty table gives
    none. Further columns are left behind.
    """
    files = (a, b) if a and b else default_files()

    def run(batches):
        one, two = sides(*files)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), texts_of(batch)
            at = 0
            while at < len(texts):
                size, z = 0, at
                while z < len(texts) and (z == at or size + len(texts[z]) <= MERGED):
                    size, z = size + len(texts[z]), z + 1
                found = align_texts(one, two, texts[at:z])
                cols = [pa.array(range(number, number + z - at), pa.int64()), pa.array(ids[at:z], pa.int64())]
                cols += [x if isinstance(x, pa.Array) else pa.array(x) for x in found.values()]
                yield pa.RecordBatch.from_arrays(cols, ["row_no", "doc_id", *found])
                number, at = number + z - at, z

    return whole_text(docs).mapInArrow(run, ROW)


def judge(aligned: DataFrame) -> DataFrame:
    """``aligned`` (stored, as it is read twice) with n_best and count_sum, by how many documents hold a pair linked."""
    held = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    spark = aligned.sparkSession
    path = scratch_path(spark, "pairs")
    held.write.mode("overwrite").parquet(path)
    held = spark.read.parquet(path)
    a = F.shiftright("pair", 32)
    best = held.groupBy(a.alias("a")).agg(F.max("count").alias("most"))
    known = held.withColumn("a", a).join(best, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    if held.count() <= BROADCAST_PAIRS:
        known = F.broadcast(known)
    # A row without pairs stays as one row with a null pair.
    single = aligned.select("row_no", F.explode_outer(F.arrays_zip("pairs", "times")).alias("x")).select("row_no", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = single.join(known, "pair", "left").groupBy("row_no").agg(
        F.coalesce(F.sum(F.when(F.col("best"), F.col("times"))), F.lit(0)).alias("n_best"), F.coalesce(F.sum(F.col("count") * F.col("times")), F.lit(0)).alias("count_sum")
    )
    return aligned.join(sums, "row_no").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op11_token_alignment")
def op11(spark, sf_dir):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    path = scratch_path(spark, "aligned")
    align(table(spark, sf_dir, "documents")).write.mode("overwrite").parquet(path)
    return judge(spark.read.parquet(path))
