"""Token alignment and jump-hash shards against brute force, and on awkward rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.llm import alignment, shards

SF = "/root/testdata/sf0.001"


def odd_texts(n=400):
    rng, bits = random.Random(3), ["a", "b", "the ", "\n", " ", "  ", "é", "漢", "🤣", "1", "23", "'s", "'LL", "\xa0", "​", ".", "!!", "<|endoftext|>", "́", "Ⅷ", "<0x41>", "<s>", "▁"]
    return [None, "", " ", "a", "</s> <unk>", "ſ ǅ ١ ² \x00", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(n))]


def brute_groups(a, b, text):
    """Groups as lists of ids, by sets of ends; None where a text has no tokens."""
    if not text:
        return None
    ids = [side.encode([text])[0] for side in (a, b)]
    if any(b"".join(side.data[i] for i in x) != b" " + text.encode() for side, x in zip((a, b), ids)):
        return None
    ends = [np.cumsum([len(side.data[i]) for i in x]).tolist() for side, x in zip((a, b), ids)]
    groups, before = [], 0
    for c in sorted(set(ends[0]) & set(ends[1])):
        groups.append(tuple([i for i, e in zip(x, at) if before < e <= c] for x, at in zip(ids, ends)))
        before = c
    return groups


def brute_rows(texts):
    a, b = alignment.sides(*alignment.default_files())
    groups = [brute_groups(a, b, t) or [] for t in texts]
    links = [Counter((x, y) for p, q in g for x in p for y in q) for g in groups]
    count = Counter(k for c in links for k in c)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    for g, c in zip(groups, links):
        digest = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g)
        yield (
            sum(len(p) for p, _ in g), sum(len(q) for _, q in g), len(g), sum(c.values()),
            sum(n for k, n in c.items() if count[k] == most[k[0]]), sum(n * count[k] for k, n in c.items()),
            hashlib.sha256(digest.encode()).hexdigest() if g else "",
        )


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_alignment_equals_brute_force(spark, monkeypatch, tmp_path, most):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", most)
    texts = odd_texts() + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(40).collect()]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pairs string").repartition(3)
    alignment.align(docs).write.parquet(str(tmp_path / "aligned"))
    found = {r["doc_id"]: tuple(r)[1:] for r in alignment.judge(spark.read.parquet(str(tmp_path / "aligned"))).collect()}
    assert [found[i] for i in range(len(texts))] == list(brute_rows(texts))


def test_ids_of_a_are_those_of_the_tokenizers_library():
    from tokenizers import Tokenizer

    path, _ = alignment.default_files()
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    texts = [t or "" for t in odd_texts(2000)]
    assert alignment.ByteSide(path).encode(texts) == [e.ids for e in library.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_lockstep_merges_documents_of_all_lengths():
    rng = np.random.default_rng(2)
    ends = [[np.unique(np.append(rng.integers(1, n + 1, n // k + 1), n)) for n in (1, 2, 50, 3000, 7)] for k in (2, 3)]
    ends = [[x[0], [], *x[1:]] for x in ends]
    at = [np.cumsum([0, *map(len, x)]) for x in ends]
    doc, a0, a1, b0, b1 = alignment.merge(np.concatenate(ends[0]).astype(int), np.concatenate(ends[1]).astype(int), *at)
    want = [(d, c) for d, (x, y) in enumerate(zip(*ends)) for c in sorted(set(x) & set(y))]
    assert [(d, ends[0][d][z - at[0][d] - 1]) for d, z in zip(doc, a1)] == want == [(d, ends[1][d][z - at[1][d] - 1]) for d, z in zip(doc, b1)]
    assert (a1 > a0).all() and (b1 > b0).all()
    assert alignment.merge(np.zeros(0, int), np.zeros(0, int), np.zeros(1, int), np.zeros(1, int)).shape == (5, 0)


def test_alignment_of_null_and_repeated_ids_and_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a text"), (None, "a text"), (1, "a text"), (1, None)], "doc_id long, text string")
    for name, rows in (("some", docs), ("none", docs.limit(0))):
        alignment.align(rows).write.parquet(str(tmp_path / name))
    found = alignment.judge(spark.read.parquet(str(tmp_path / "some"))).collect()
    assert sorted(str(r["doc_id"]) for r in found) == ["1", "1", "None", "None"] and {r["count_sum"] for r in found} == {0, 6}
    assert alignment.judge(spark.read.parquet(str(tmp_path / "none"))).count() == 0


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_equals_its_definition_and_moves_rows_only_to_the_new_shard():
    rng = random.Random(1)
    keys = [0, 1, (1 << 64) - 1, *(rng.getrandbits(64) for _ in range(3000))]
    before = None
    for n in (1, 2, 16, 17, 1000):
        found = shards.jump(np.array(keys, np.uint64), n)
        assert found.tolist() == [plain_jump(k, n) for k in keys]
        if n == 17:
            assert set(found[found != before]) == {16} and abs((found != before).mean() - 1 / 17) < 0.02
        before = found
    with pytest.raises(ValueError):
        shards.jump(np.array([1], np.uint64), 0)


def test_shards_keep_rows_and_number_them_without_a_gap(spark, tmp_path):
    rows = [(i % 50 if i % 7 else None, None if i % 11 == 0 else f"text {i}", 5, "p") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, shard string, place long, part string").repartition(5)
    path = str(tmp_path / "shards")
    shards.write_shards(docs, path, 6)
    found = shards.read_shards(spark, path)
    assert sorted(map(str, found.select("row.*").collect())) == sorted(map(str, docs.collect()))
    by = defaultdict(list)
    of = defaultdict(set)
    for r in found.collect():
        by[r["shard"]].append(r["slot"])
        of[r["row"]["doc_id"]].add(r["shard"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and all(len(x) == 1 for x in of.values())
    empty = str(tmp_path / "empty")
    shards.write_shards(docs.limit(0), empty, 6)
    assert shards.read_shards(spark, empty, "doc_id bigint, shard string, place bigint, part string").count() == 0


def test_shard_query(spark):
    found = shards.op13(spark, SF).toPandas()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(found.doc_id) == sorted(texts)
    for r in found.itertuples():
        data = texts[r.doc_id].encode()
        assert (r._asdict()["size"], r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key") and r.grown_shard in (r.shard, 16)
    keys = spark.createDataFrame([(i,) for i in texts], "doc_id long").select("doc_id", F.xxhash64("doc_id").alias("h")).collect()
    want = {r["doc_id"]: (plain_jump(r["h"] % (1 << 64), 16), plain_jump(r["h"] % (1 << 64), 17)) for r in keys}
    assert {r.doc_id: (r.shard, r.grown_shard) for r in found.itertuples()} == want
