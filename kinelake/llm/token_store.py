"""Token ids in binary pages with Elias-Fano document boundaries.

Documents are dealt by ranges of doc_id, the shards, which are in ascending order and sorted inside. A shard is
written as pages: a page is the concatenated ids of whole documents (two bytes an id while the
vocabulary allows it, else four) and two Elias-Fano sequences, the documents' end offsets and their doc_ids. An
Elias-Fano sequence keeps the low bits of each value in a packed array and the high bits as unary gaps; select of the
i-th one-bit gives the i-th value, in about 2 + log2(range / n) bits a value, with no table of 64-bit offsets. Pages
are rows of a Parquet folder, written and committed by Spark, so any store that Spark writes to will do.

The ids before a page are sums of page sizes: first by shard, then by page inside the shard.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.llm.common import id_range, query, small_batches, table, texts_of, whole_text
from kinelake.sources.store import scratch_path

#: Ids after which a page is closed; a longer document has a page of its own.
PAGE = 1 << 20
END = 1
#: Documents in one shard, and the most shards.
SHARD_ROWS, MOST_SHARDS = 1024, 8192
REMEMBERED = 500_000
#: New words given to the library in one string.
LINE = 64
#: White space for str.split() but not for the tokenizer.
SEPARATORS = re.compile("[\x1c-\x1f]")


class EliasFano:
    """A non-decreasing sequence of non-negative numbers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if n and (values[0] < 0 or np.any(np.diff(values) < 0)):
            raise ValueError("the sequence must be non-negative and non-decreasing")
        top = int(values[-1]) if n else 0
        low_bits = max(0, ((top + 1) // n).bit_length() - 1) if n else 0
        if low_bits:
            bits = (values[:, None] >> np.arange(low_bits)) & 1
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        marks = np.zeros(n + (top >> low_bits) + 1 if n else 0, np.uint8)
        marks[(values >> low_bits) + np.arange(n)] = 1
        return cls(n, low_bits, low, np.packbits(marks, bitorder="little"))

    def to_bytes(self) -> bytes:
        return struct.pack("<qbqq", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, a, b = struct.unpack_from("<qbqq", data)
        at = struct.calcsize("<qbqq")
        return cls(n, low_bits, np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a))

    def _select(self) -> np.ndarray:
        """Positions of all one-bits in the high part."""
        return np.flatnonzero(np.unpackbits(self.high, bitorder="little"))

    def values(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.int64)
        out = (self._select()[: self.n] - np.arange(self.n)) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, -1)
            out += bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return out

    def get(self, i: int) -> int:
        """The i-th value alone: select by byte counts, then within a byte; reads low bits of that value only."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        ones = np.cumsum(np.bitwise_count(self.high))
        byte = int(np.searchsorted(ones, i + 1))
        before = int(ones[byte - 1]) if byte else 0
        inside = np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))[i - before]
        out = (8 * byte + int(inside) - i) << self.low_bits
        for k in range(self.low_bits):
            at = i * self.low_bits + k
            out |= ((int(self.low[at >> 3]) >> (at & 7)) & 1) << k
        return out


class Words:
    """Ids of texts by the tokenizers library, word by word.

    The vocabulary drops white space and marks where a word ends, so a text's ids are those of its white-space
    separated parts in order. Parts are remembered; new ones go to the library together, one to a line.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of strings as they are, by the library alone."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _learn(self, parts: list[str]) -> None:
        """Letters-only parts are one word each: their ids are cut at word ends. Others go to the library singly."""
        plain = [p for p in parts if p.isalpha()]
        odd = [p for p in parts if not p.isalpha()]
        lines = [plain[at : at + LINE] for at in range(0, len(plain), LINE)]
        for some, data in zip(lines, self.whole([" ".join(x) for x in lines])):
            ids = np.frombuffer(data, self.dtype)
            ends = ((np.flatnonzero(self.closes[ids]) + 1) * ids.itemsize).tolist()
            if len(ends) != len(some):  # a letter that the vocabulary writes as several words
                odd += some
                continue
            at = 0
            for p, end in zip(some, ends):
                self.known[p] = data[at:end]
                at = end
        if odd:
            self.known.update(zip(odd, self.whole(odd)))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            # What was met since the last time stays within reach for one more round.
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        strange = {i for i, t in enumerate(texts) if SEPARATORS.search(t)}
        cut = [[] if i in strange else t.split() for i, t in enumerate(texts)]
        new = set(chain.from_iterable(cut)).difference(known)
        again = [p for p in new if p in older] if older else []
        for p in again:
            known[p] = older[p]
        new.difference_update(again)
        # A word with marks behind it: the word and the marks are two parts for the library as well.
        split = {}
        for p in [p for p in new if not p.isalpha()]:
            stem = p.rstrip(".,!?;:#$%&*|")
            if stem.isalpha():
                split[p] = (stem, p[len(stem) :])
                new.discard(p)
                for x in split[p]:
                    if x not in known:
                        if x in older:
                            known[x] = older[x]
                        else:
                            new.add(x)
        self._learn(sorted(new))
        for p, (a, b) in split.items():
            known[p] = known[a] + known[b]
        out = [b"".join(map(known.__getitem__, parts)) for parts in cut]
        for i in strange:
            out[i] = self.whole([texts[i]])[0]
        return out


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """(doc_id, ids binary) of every row, the end id appended; null texts are empty, so just the end id."""

    def run(batches):
        w = words(tokenizer)
        tail = np.array([end], w.dtype).tobytes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x + tail for x in w.encode(texts_of(b))], pa.binary())], ["doc_id", "ids"])

    return whole_text(docs).mapInArrow(run, "doc_id long, ids binary")


PAGES = "shard int, page int, n_docs long, n_ids long, width int, doc_base long, doc_ids binary, ends binary, ids binary"


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, page: int = PAGE) -> None:
    """Encode ``docs`` and write the pages under ``path``, ascending by doc_id (rows of equal doc_id by their ids).

    Rows without a doc_id cannot be addressed and raise an error. An empty table gives an empty folder of pages.
    """
    tokenizer = tokenizer or default_tokenizer()
    names = [x.split()[0] for x in PAGES.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    width = words(tokenizer).dtype.itemsize

    def run(batches):
        shard, number, ids, docs_ = None, 0, [], []

        def close():
            ends = np.cumsum([len(x) // width for x in ids])
            row = (shard, number, len(ids), int(ends[-1]), width, docs_[0], EliasFano.of(np.array(docs_) - docs_[0]).to_bytes(), EliasFano.of(ends).to_bytes(), b"".join(ids))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names)

        size = 0
        for b in batches:
            for range_no, doc_id, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if doc_id is None:
                    raise ValueError("a document without doc_id cannot be stored")
                if ids and (range_no != shard or size + len(x) // width > page):
                    yield close()
                    ids, docs_, size = [], [], 0
                    number += 1
                if range_no != shard:
                    shard, number = range_no, 0
                ids.append(x)
                docs_.append(doc_id)
                size += len(x) // width
        if ids:
            yield close()

    small_batches(docs.sparkSession)
    shard_no = id_range(docs.select(F.col("doc_id").cast("long").alias("doc_id")), SHARD_ROWS, MOST_SHARDS)
    coded = encode(docs, tokenizer, end).select(shard_no.alias("shard"), "doc_id", "ids")
    coded.repartition("shard").sortWithinPartitions("shard", "doc_id", "ids").mapInArrow(run, PAGES).write.mode("overwrite").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids."""
    pages = spark.read.schema(PAGES).parquet(path)
    sizes = pages.select("shard", "page", "n_ids")
    # One row per shard (at most MOST_SHARDS), then one row per page inside it.
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    inside = sizes.select("shard", "page", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("page")) - F.col("n_ids")).alias("inside"))
    starts = inside.join(before, "shard").select("shard", "page", (F.col("before") + F.col("inside")).alias("page_start"))
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                ends = EliasFano.from_bytes(row["ends"]).values()
                docs = EliasFano.from_bytes(row["doc_ids"]).values() + row["doc_base"]
                starts_, w = np.concatenate(([0], ends[:-1])), row["width"]
                ids = np.frombuffer(row["ids"], f"<u{w}").astype("<u4")
                data = memoryview(ids).cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip(starts_.tolist(), ends.tolist())]
                n = len(docs)
                cols = [np.full(n, row["shard"]), np.full(n, row["page"]), docs, starts_, ends - starts_, np.array(crc, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["shard", "page", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = pages.mapInArrow(run, "shard int, page int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["shard", "page"]).select("doc_id", (F.col("page_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


@query("op9_token_store")
def op9(spark, sf_dir):
    path = scratch_path(spark, "tokens")
    write_store(table(spark, sf_dir, "documents"), path)
    return read_store(spark, path)
