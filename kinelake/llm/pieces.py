"""SentencePiece encoding and decoding: best segmentation over a piece vocabulary, giant texts by a max-plus scan.

The score of a segmentation is the sum of its pieces' log-probabilities and the best one is searched (the unigram
lattice). A vocabulary of the BPE kind holds merge ranks instead; a piece of rank r then counts as -ln(r + 1), the
log-probability of a Zipf law, in millionths as whole numbers, so sums are exact in any order. A character outside
the vocabulary is one edge at a price below every piece and comes out as its UTF-8 byte pieces.

Texts up to ``GIANT`` code points are segmented where they are read. Longer ones are cut into chunks of ``CHUNK`` code
points. A piece may straddle a border, so the state at a border is how many characters the last piece reaches over it.
Each chunk yields the matrix of the best score from every state before it to every state behind it, by itself. These
matrices combine associatively under (max, +); a prefix scan over them gives the best border states, and then every
chunk is traced back by itself between its two states. All three steps are Spark stages over chunk rows.
"""

from __future__ import annotations

import math
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.common import ids_list, query, table, texts_of, whole_text

GIANT = 1 << 16
CHUNK = 1 << 14
#: Characters of the stretches whose result a worker remembers, whole texts without a space included; emptied when full.
REMEMBERED = 1 << 21
SPACE, NEG = "▁", -(10**15)
#: Stands for a U+2581 that is in the text itself: no text holds a lone surrogate.
LITERAL = "\ud800"
RUNS = re.compile(f"{SPACE}+[^{SPACE}\n{LITERAL}]*|[^{SPACE}\n{LITERAL}]+|[\n{LITERAL}]")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces with whole-number scores. ``paths`` finds the best paths through strings."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = model.SentencePiece
        plain = [(i, p) for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
        ranked = model.trainer_spec.model_type == model.trainer_spec.BPE
        price = (lambda s: -math.log(min(-s, len(model.pieces)) + 1)) if ranked else float
        self.ids = {p.piece: i for i, p in plain}
        self.score = {p.piece: round(1e6 * price(p.score)) for i, p in plain}
        self.unknown = min(self.score.values()) - 10_000_000
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        if len(self.byte) != 256:
            raise ValueError("the model needs the 256 byte pieces for an exact round trip")
        self.longest = max(map(len, self.score))
        inner = [p for p in self.score if SPACE in p.lstrip(SPACE) or "\n" in p]
        if inner or len(model.pieces) > 65536:
            raise ValueError("pieces across a word border or more than 65,536 pieces are not supported")
        self.bytes = [b""] * len(model.pieces)
        for i, p in plain:
            self.bytes[i] = p.piece.replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.bytes[i] = bytes([b])
        self.prefixes = {p[:k]: NEG for p in self.score for k in range(1, len(p))} | self.score
        self.suffixes = {p[k:]: NEG for p in self.score for k in range(1, len(p))} | self.score
        self.pairs = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        self.known: dict[str, bytes] = {"": b""}
        self.values: dict[str, int] = {}
        self.known_size = self.values_size = 0

    def edges(self, s: str, i: int):
        """(end, score) of the pieces that start at i; a character that is no piece is an edge of its own."""
        if s[i] not in self.score:
            yield i + 1, self.unknown
        for j in range(i + 1, len(s) + 1):
            x = self.prefixes.get(s[i:j])
            if x is None:
                return
            if x > NEG:
                yield j, x

    def paths(self, ordered: list[str]):
        """(best score, ids) of each whole string; ties keep the earliest start of the last piece.

        The search goes from each end back over the pieces that end there, so its values belong to prefixes; strings in
        order share them with the string before.
        """
        get, before, best, back = self.suffixes.get, "", [0], [0]
        for s in ordered:
            n, k = len(s), 0
            for a, b in zip(s, before):
                if a != b:
                    break
                k += 1
            del best[k + 1 :], back[k + 1 :]
            before = s
            for j in range(k + 1, n + 1):
                i = j - 1
                x = get(s[i:j])
                if x is None or x == NEG:
                    top, at = best[i] + self.unknown, i
                else:
                    top, at = best[i] + x, i
                while x is not None and i:
                    i -= 1
                    x = get(s[i:j])
                    if x is not None and best[i] + x >= top:
                        top, at = best[i] + x, i
                best.append(top)
                back.append(at)
            out, at = [], n
            while at:
                start = back[at]
                found = self.ids.get(s[start:at])
                if found is None:
                    out += [self.byte[b] for b in reversed(s[start:at].replace(LITERAL, SPACE).encode())]
                else:
                    out.append(found)
                at = start
            out.reverse()
            yield best[n], array("H", out).tobytes()

    def remember(self, parts) -> dict[str, bytes]:
        """Ids of every stretch in ``parts``, each searched once while it is remembered."""
        if self.known_size > REMEMBERED:
            self.known, self.known_size = {"": b""}, 0
        known, pairs, split = self.known, self.pairs, {}
        new = set(parts).difference(known)
        for s in [s for s in new if not s[1:].isalpha()]:
            # Where no piece holds two neighbours, every path is cut: the sides are searched alone.
            inner = [i for i in range(1, len(s)) if s[i - 1 : i + 1] not in pairs]
            if inner:
                split[s] = [s[a:b] for a, b in zip([0, *inner], [*inner, len(s)])]
                new.discard(s)
                new.update(x for x in split[s] if x not in known)
        ordered = sorted(new)
        for s, (_, ids) in zip(ordered, self.paths(ordered)):
            known[s] = ids
        for s, sides in split.items():
            known[s] = b"".join(map(known.__getitem__, sides))
        self.known_size += sum(map(len, ordered)) + sum(map(len, split))
        return known

    def value(self, s: str) -> int:
        """Best score of a stretch."""
        if self.values_size > REMEMBERED:
            self.values, self.values_size = {}, 0
        if s not in self.values:
            self.values[s] = next(self.paths([s]))[0]
            self.values_size += len(s)
        return self.values[s]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def normal(text: str) -> str:
    """The text as the lattice sees it: one mark before it, spaces as marks."""
    return SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE) if text else ""


def segments(text: str) -> list[str]:
    """Stretches that no piece leaves: before each run of marks and around line ends."""
    if SPACE in text or "  " in text or text[:1] == " ":
        return RUNS.findall(normal(text))
    return (SPACE + text.replace(" ", f" {SPACE}").replace("\n", " \n ")).split(" ") if text else []


def encode(vocab: Vocabulary, texts: list[str]) -> list[bytes]:
    """Ids of whole texts. Stretches are independent parts of the lattice, so each is searched alone, once."""
    cut = [segments(t) for t in texts]
    known = vocab.remember(chain.from_iterable(cut))
    return [b"".join(map(known.__getitem__, parts)) for parts in cut]


def decode(vocab: Vocabulary, ids: bytes) -> str:
    """The text of the ids: pieces and bytes in a row, less the mark that encoding put in front."""
    table_ = vocab.bytes
    return b"".join([table_[i] for i in np.frombuffer(ids, "<u2").tolist()])[1:].decode("utf-8", "replace")


def cuts(s: str, end: int) -> tuple[int, int] | None:
    """First and last position from 1 to ``end`` that no piece straddles."""
    def is_cut(p):
        return s[p - 1] in ("\n", LITERAL) or s[p : p + 1] in ("\n", LITERAL) or (s[p : p + 1] == SPACE and s[p - 1] != SPACE)

    first = next((p for p in range(1, min(end, len(s)) + 1) if is_cut(p)), None)
    if first is None:
        return None
    return first, next(p for p in range(min(end, len(s)), 0, -1) if is_cut(p))


def transfer(vocab: Vocabulary, s: str, size: int) -> np.ndarray:
    """Best scores from each entry state to each exit state of the chunk s[:size]; s goes on behind it by lookahead.

    Entry i: the chunk is covered from its i-th character on. Exit j: the last piece reaches j characters behind it.
    Between the first and last cut all paths run through both, so only the ends need a search from every state.
    """
    n, states = size, vocab.longest
    out = np.full((states, states), NEG, np.int64)

    def forward(start, stop, scores):
        """Scores (dict position -> vector over entries) carried on over pieces that start before ``stop``."""
        for i in range(start, stop):
            if i in scores:
                for j, x in vocab.edges(s, i):
                    got = scores[i] + x
                    scores[j] = np.maximum(scores[j], got) if j in scores else got
        return scores

    begin = {}
    for i in range(min(states, n + states)):
        v = np.full(states, NEG, np.int64)
        v[i] = 0
        begin[i] = v
    found = cuts(s, n)
    if found is None:
        reached = forward(0, n, begin)
        return _exits(reached, n, out)
    first, last = found
    # No piece straddles a cut, so a state behind the first one is impossible.
    entry = forward(0, first, {k: v for k, v in begin.items() if k <= first})[first]
    middle = sum(vocab.value(part) for part in RUNS.findall(s[first:last]))
    reached = forward(last, n, {last: np.zeros(1, np.int64)})
    for j in range(states):
        if n + j in reached:
            out[:, j] = np.where(entry > NEG // 2, entry + middle + int(reached[n + j][0]), NEG)
    return out


def _exits(reached, n, out):
    for j in range(out.shape[1]):
        if n + j in reached:
            out[:, j] = np.maximum(reached[n + j], NEG)
    out[out < NEG // 2] = NEG
    return out


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two batches of matrices: first a, then b. Associative."""
    out = np.full(a.shape, NEG, np.int64)
    for k in range(a.shape[-1]):
        np.maximum(out, a[..., :, k, None] + b[..., k, None, :], out=out)
    return np.maximum(out, NEG)


def border_states(matrices: np.ndarray) -> list[tuple[int, int]]:
    """(entry, exit) of every chunk on the best path, from the chunks' matrices in order."""
    prefix, step = matrices.copy(), 1
    while step < len(prefix):  # inclusive scan by doubling
        prefix[step:] = combine(prefix[:-step].copy(), prefix[step:])
        step *= 2
    states, leave = [], 0
    for k in range(len(matrices) - 1, -1, -1):
        enter = int(np.argmax(prefix[k - 1][0] + matrices[k][:, leave])) if k else 0
        states.append((enter, leave))
        leave = enter
    return states[::-1]


def _lattice(s: str) -> str:
    return s.replace(SPACE, LITERAL).replace(" ", SPACE)


def _chunks(docs: DataFrame, size: int, ahead: int) -> DataFrame:
    """Rows (doc_id, text_no, chunk_no, size, s): each chunk with the characters behind it, dealt over all tasks."""

    def emit(batches):
        for b in batches:
            for doc_id, text_no, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                s = " " + text
                for at in range(0, len(s), 64 * size):
                    starts = range(at, min(at + 64 * size, len(s)), size)
                    n = len(starts)
                    rows = [[doc_id] * n, [text_no] * n, [a // size for a in starts], [min(size, len(s) - a) for a in starts], [s[a : a + size + ahead] for a in starts]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["doc_id", "text_no", "chunk_no", "size", "s"])

    named = docs.select("doc_id", F.xxhash64("text").alias("text_no"), "text")
    return named.mapInArrow(emit, "doc_id long, text_no long, chunk_no int, size int, s string").repartition("doc_id", "text_no", "chunk_no")


def encode_giant(docs: DataFrame, model: str, size: int = CHUNK) -> DataFrame:
    """(doc_id, text_no, ids of the chunks in order) of long texts, by transfer matrices, scan and backtrace."""
    longest = vocabulary(model).longest

    def matrices(batches):
        vocab = vocabulary(model)
        for b in batches:
            made = [transfer(vocab, _lattice(s), n).tobytes() for n, s in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(made, pa.binary())], ["doc_id", "text_no", "chunk_no", "m"])

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_no").drop_duplicates("chunk_no")
        m = np.stack([np.frombuffer(x, np.int64).reshape(longest, longest) for x in pdf["m"]])
        states = border_states(m)
        return pdf[["doc_id", "text_no", "chunk_no"]].assign(enter=[a for a, _ in states], leave=[b for _, b in states])

    def trace(batches):
        vocab = vocabulary(model)
        for b in batches:
            d = b.to_pydict()
            ids = []
            for s, n, enter, leave in zip(d["s"], d["size"], d["enter"], d["leave"]):
                # The best path runs through every cut, so the stretches between cuts are traced alone.
                parts = RUNS.findall(_lattice(s)[enter : n + leave])
                ids.append(b"".join(map(vocab.remember(parts).__getitem__, parts)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(ids, pa.binary())], ["doc_id", "text_no", "chunk_no", "ids"])

    key = "doc_id long, text_no long, chunk_no int"
    cut = _chunks(docs, size, longest)
    states = cut.mapInArrow(matrices, f"{key}, m binary").groupBy("doc_id", "text_no").applyInPandas(scan, f"{key}, enter int, leave int")
    on = [cut[c].eqNullSafe(states[c]) for c in ("doc_id", "text_no", "chunk_no")]
    joined = cut.join(states, on[0] & on[1] & on[2]).select(cut["doc_id"], cut["text_no"], cut["chunk_no"], "size", "s", "enter", "leave")
    ids = joined.mapInArrow(trace, f"{key}, ids binary")
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", "ids")))
    return ids.groupBy("doc_id", "text_no").agg(F.transform(parts, lambda p: p["ids"]).alias("ids"))


def encode_documents(docs: DataFrame, model: str | None = None, giant: int = GIANT, size: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids (list of int), decoded (text), round_trip (boolean).

    Every whole text is encoded, and decoded again from its ids. A null text is empty, an empty text has no ids, ties
    go to the path whose last piece starts first, repeated rows are encoded each, an empty table gives none.
    """
    model = model or default_model()
    rows = whole_text(docs)
    schema = "doc_id long, n_tokens int, ids array<int>, decoded string, round_trip boolean"

    def finish(ids, b, vocab, texts):
        back = [decode(vocab, x) for x in ids]
        same = [x == t for x, t in zip(back, texts)]
        cols = [b.column(0), pa.array([len(x) // 2 for x in ids], pa.int32()), ids_list(ids), pa.array(back, pa.string()), pa.array(same)]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids", "decoded", "round_trip"])

    def direct(batches):
        vocab = vocabulary(model)
        for b in batches:
            texts = texts_of(b)
            yield finish(encode(vocab, texts), b, vocab, texts)

    def rejoined(batches):
        vocab = vocabulary(model)
        for b in batches:
            yield finish([b"".join(x) for x in b.column(2).to_pylist()], b, vocab, texts_of(b))

    short = rows.filter(F.length("text") <= giant).mapInArrow(direct, schema)
    long = rows.filter(F.length("text") > giant).withColumn("text_no", F.xxhash64("text"))
    coded = encode_giant(long.select("doc_id", "text").distinct(), model, size)
    on = long["doc_id"].eqNullSafe(coded["doc_id"]) & (long["text_no"] == coded["text_no"])
    joined = long.join(coded, on).select(long["doc_id"], long["text"], coded["ids"])
    return short.union(joined.mapInArrow(rejoined, schema))


@query("op2_sentencepiece_round_trip")
def op2(spark, sf_dir):
    found = encode_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip")
