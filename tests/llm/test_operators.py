"""Text operators against brute force, round trips and held-out accuracy, and on awkward rows."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinelake.llm import chat, common, decontaminate, extract, pieces, quality, resemble, simhash, sketch, spans, token_store, toxicity

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, a long text, ties, repeated rows, and columns named like the operators' own."""
    long = " ".join(f"word{i % 977} sits." for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "Two words"), (4, "Two words"), (5, "Two words"), (None, "no id here"), (6, long), (7, long), (8, "漢字 ñandú ▁ x  y\u0130 'S")]
    pdf = pd.DataFrame([(i, t, None, "s", None) for i, t in rows], columns=["doc_id", "text", "lang", "source", "n_chars"])
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("fp", "h", "spans", "bucket", "ids", "text_no", "score", "held_out", "matches", "shard", "sketch", "next_text", "i", "j", "u", "v", "root", "removed_sentences"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF2}/labels.parquet").withColumn("text", F.lit("clash")).union(spark.createDataFrame([(None, None, None, None)], "doc_id long, quality int, toxic int, text string"))


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet").union(spark.createDataFrame([(None, None), (9999, "")], "item_id long, text string"))


def test_every_operator_on_awkward_rows_and_empty_tables(spark, odd, labels, benchmark):
    whole = {
        "1": lambda d: decontaminate.find_overlaps(d, benchmark),
        "2": lambda d: pieces.encode_documents(d, giant=1000, size=500),
        "3": lambda d: quality.classify(d, labels),
        "4": lambda d: spans.remove_repeats(d),
        "5": lambda d: toxicity.classify(d, labels),
        "10": lambda d: simhash.near_duplicates(d),
    }
    for name, run in whole.items():
        found = run(odd).toPandas()
        assert len(found) == 10, name
        assert run(odd.limit(0)).count() == 0, name
    encoded = pieces.encode_documents(odd, giant=1000, size=500).toPandas()
    assert encoded["round_trip"].all()
    with_id = odd.filter("doc_id IS NOT NULL")
    assert len(sketch.edited_pairs(with_id).toPandas()) == 9
    assert sketch.edited_pairs(odd.limit(0)).count() == 0
    same = simhash.near_duplicates(odd).toPandas()
    assert set(same[same.doc_id.isin([1, 2, 3])].component_id) == {1}
    assert set(same[same.doc_id.isin([6, 7])].component_id) == {6}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(kept.toPandas()["doc_id"].dropna().tolist()) == [1, 4, 6, 8]
    gone = spans.remove_repeats(odd).toPandas().set_index("doc_id")
    assert gone.loc[7, "text"] == "" and gone.loc[6, "removed_sentences"] > 0 and pd.isna(gone.loc[1, "text"])


def hamming_components(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def plain_simhash(text):
    import xxhash

    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", w) if x]
    if not w:
        return 0
    runs = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_components_equal_all_pairs(spark, docs):
    found = simhash.near_duplicates(docs).toPandas()
    texts = docs.toPandas().set_index("doc_id")["text"]
    fps = {i: plain_simhash(t or "") for i, t in texts.items()}
    root = hamming_components(set(fps.values()))
    least = {}
    for i, f in sorted(fps.items()):
        least.setdefault(root[f], i)
    for r in found.itertuples():
        assert r.fp & (2**64 - 1) == fps[r.doc_id] and r.component_id == least[root[fps[r.doc_id]]]


def plain_shingles(t):
    w = t.encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stage_joins_near_copies_of_eight_tenths_as_brute_force_does(spark):
    rng, texts = random.Random(11), []
    words = [f"w{i}" for i in range(3000)]
    for _ in range(20):
        own = [rng.choice(words) for _ in range(200)]
        texts.append(" ".join(own))
        for cuts in (1, 2, 4, 6, 9, 14):  # a changed word breaks five shingles: similarities from about 0.97 to 0.5
            copy = list(own)
            for k in rng.sample(range(200), cuts):
                copy[k] = "changed"
            texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets, fps = [plain_shingles(t) for t in texts], [plain_simhash(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) or (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    kept = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    assert kept == sorted(set(root)) and 20 < len(kept) < 100


def test_rounds_compare_every_pair_of_a_bucket(spark, monkeypatch):
    """Two groups in one bucket, as if by a chance of the signature: both are found, whichever way the rest is compared."""
    a, b = [" ".join(f"{x}{i}" for i in range(60)) for x in "ab"]
    texts = [" ".join(t.split()[k:]) for t in (a, b) for k in range(2)]
    sets = [resemble.shingles(t) for t in texts]
    one = [(resemble.node_of(s), len(s), [7], t) for s, t in zip(sets, texts)]
    df = spark.createDataFrame(one, "node long, n long, bands array<long>, text string")
    for pairs in (0, 100):
        monkeypatch.setattr(resemble, "PAIRS", pairs)
        edges = resemble.similar(df.select("node", "n", "bands"), df.select("node", "text"))
        roots = {r.node: r.root for r in common.components(edges).collect()}
        assert len(roots) == 4 and roots[one[0][0]] == roots[one[1][0]] and roots[one[2][0]] == roots[one[3][0]]
        assert roots[one[0][0]] != roots[one[2][0]]


def test_estimates_of_many_rounds_stay_small(spark, monkeypatch):
    """A bucket of unlike texts takes a round for each node; the digits of Spark's size estimates must not multiply with them."""
    texts = [" ".join(f"w{i}_{k}" for k in range(30)) for i in range(7)]
    texts.append(texts[0] + " more")
    one = [(resemble.node_of(s), len(s), [7, 8], t) for t in texts for s in [resemble.shingles(t)]]
    df = spark.createDataFrame(one, "node long, n long, bands array<long>, text string")
    bits, cut = [], resemble.reliable

    def told(rows):
        out = cut(rows)
        bits.append(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())
        return out

    monkeypatch.setattr(resemble, "reliable", told)
    monkeypatch.setattr(resemble, "PAIRS", 0)
    edges = resemble.similar(df.select("node", "n", "bands"), df.select("node", "text"))
    assert {tuple(sorted(r)) for r in edges.collect()} == {tuple(sorted((one[0][0], one[-1][0])))}
    assert len(bits) > 15 and max(bits) < 1000


def test_rounds_take_more_nodes_each(spark, monkeypatch):
    """Twenty unlike texts with four copies in one bucket: no link is lost when a round compares several nodes, and rounds are few."""
    texts = [" ".join(f"w{i}_{k}" for k in range(30)) for i in range(20)]
    texts += [t + " more" for t in texts[3:20:5]]
    one = [(resemble.node_of(s), len(s), [7], t) for t in texts for s in [resemble.shingles(t)]]
    df = spark.createDataFrame(one, "node long, n long, bands array<long>, text string")
    rounds, facts = [], resemble._facts
    monkeypatch.setattr(resemble, "_facts", lambda left, most: rounds.append(most) or facts(left, most))
    monkeypatch.setattr(resemble, "PAIRS", 4)
    edges = resemble.similar(df.select("node", "n", "bands"), df.select("node", "text"))
    wanted = {tuple(sorted((one[i][0], one[20 + k][0]))) for k, i in enumerate(range(3, 20, 5))}
    assert {tuple(sorted(r)) for r in edges.collect()} == wanted
    assert rounds[:3] == [1, 2, 4] and len(rounds) <= 6


def test_hot_shards_are_dealt_again_and_keep_every_link(spark):
    random.seed(3)
    near = [0]
    for _ in range(299):
        f = random.choice(near)
        for _ in range(random.choice([1, 2, 2, 3])):
            f ^= 1 << random.randrange(64)
        near.append(f)
    values = sorted({*near, *(random.getrandbits(64) for _ in range(100))})
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = hamming_components(values)
    for shard in (4, 1000):
        edges = simhash.links(df, shard=shard).toPandas()
        parent = {v: v for v in values}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in zip(edges.a, edges.b):
            assert want[int(a) & (2**64 - 1)] == want[int(b) & (2**64 - 1)]
            parent[find(int(a) & (2**64 - 1))] = find(int(b) & (2**64 - 1))
        groups = {}
        for v in values:
            groups.setdefault(find(v), set()).add(v)
        expected = {}
        for v in values:
            expected.setdefault(want[v], set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_bk_tree_follows_only_edges_within_the_radius():
    tree, values = simhash.BKTree(), [random.Random(i).getrandbits(16) for i in range(400)]
    for v in values:
        tree.add(v)
    for q in range(0, 65536, 997):
        assert sorted(tree.values[i] for i in tree.within(q, 3)) == sorted({v for v in values if (v ^ q).bit_count() <= 3})


def test_chunked_scan_equals_whole_search():
    vocab, rng = pieces.vocabulary(pieces.default_model()), random.Random(5)
    texts = ["".join(rng.choice("ab the\nñ漢▁.  ") for _ in range(rng.randint(1, 120))) for _ in range(120)]
    price = {i: vocab.score[p] for p, i in vocab.ids.items()}
    for t in texts:
        size = rng.choice([1, 3, 16, 40])
        s = pieces._lattice(" " + t)
        cut = [(s[a : a + size + vocab.longest], min(size, len(s) - a)) for a in range(0, len(s), size)]
        states = pieces.border_states(np.stack([pieces.transfer(vocab, c, n) for c, n in cut]))
        parts = [pieces.RUNS.findall(c[a : n + b]) for (c, n), (a, b) in zip(cut, states)]
        ids = b"".join(vocab.remember(p)[x] for p in parts for x in p)
        whole = pieces.encode(vocab, [t])[0]
        assert pieces.decode(vocab, ids) == pieces.decode(vocab, whole) == t
        total = [sum(price.get(int(i), 0) for i in np.frombuffer(x, "<u2")) for x in (ids, whole)]
        assert total[0] == total[1]


def test_combination_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = (rng.integers(-1000, 0, (3, 5, 5)) for _ in range(3))
    assert (pieces.combine(pieces.combine(a, b), c) == pieces.combine(a, pieces.combine(b, c))).all()


def test_best_score_equals_the_library_s_unigram_search():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    vocab = pieces.vocabulary(pieces.default_model())
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(pieces.default_model(), "rb").read())
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    for p in model.pieces:
        if p.piece in vocab.score:
            p.score = vocab.score[p.piece] / 1e6
    lib = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    price = {i: s for p, s in vocab.score.items() for i in [vocab.ids[p]]}
    for t in ("The and attion to thanedble the", "heitschä den vereinbe", "plain words only"):
        own = sum(price[int(i)] for i in np.frombuffer(pieces.encode(vocab, [t])[0], "<u2"))
        assert abs(own - sum(price[i] for i in lib.encode(t))) <= 5


def test_spans_remove_all_but_the_first(spark):
    passage = "Here begins a shared passage of text. It goes on for a good many more words than needed! Then it ends with this last sentence of it."
    rows = [(3, f"Alpha beta gamma delta. {passage} Omega one."), (1, f"First text and {passage} tail words follow"), (2, "A clean one. With nothing in common at all."), (4, passage)]
    found = {r["doc_id"]: r for r in spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1]["text"] == rows[1][1] and found[2]["text"] == rows[2][1] and found[2]["removed_sentences"] == 0
    assert found[3]["text"] == "Alpha beta gamma delta. Omega one." and found[4]["text"] == ""


def test_spans_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())
    first, gone = {}, {}
    for i, t in rows:
        cut = [" ".join(t[a:b].lower().split()) for a, b in spans.sentences(t)]
        for _, a, b in sorted(spans.runs(t), key=lambda x: x[1:]):
            key = tuple(cut[a : b + 1])
            if first.setdefault(key, (i, a, b)) != (i, a, b):
                gone.setdefault(i, set()).update(range(a, b + 1))
    found = {r["doc_id"]: r["removed_sentences"] for r in spans.remove_repeats(docs).collect()}
    assert found == {i: len(gone.get(i, ())) for i, _ in rows} and gone


def test_overlaps_with_substitutions_are_found(spark):
    words = [f"tok{i}" for i in range(40)]
    item = " ".join(words)
    changed = words.copy()
    for k in (6, 14, 22, 30):
        changed[k] = "other"
    rows = [(1, "lead in " + " ".join(changed) + " lead out"), (2, "nothing to see"), (3, " ".join(words[:11])), (4, item.upper())]
    bench = spark.createDataFrame([(7, item), (8, "short one")], "item_id long, text string")
    for size in (decontaminate.BLOCK_TOKENS, 8):
        found = {r["doc_id"]: r for r in decontaminate.find_overlaps(spark.createDataFrame(rows, "doc_id long, text string"), bench, size=size).collect()}
        assert [found[i]["contaminated"] for i in (1, 2, 3, 4)] == [True, False, False, True]
        assert found[1]["item_ids"] == [7] and found[1]["clean_text"] == "lead in  lead out" and found[2]["clean_text"] == rows[1][1]


def test_rows_with_a_null_or_repeated_id_are_told_apart_by_their_text(spark):
    item = " ".join(f"item{i}" for i in range(20))
    texts = [" ".join(f"{x}{i}" for i in range(30)) for x in "abc"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, "quite another text of its own"), (None, "before " + item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()]
    assert len(kept) == 5 and set(kept) == set(rows)
    clean = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(map(str, clean.collect())) == sorted(map(str, docs.collect()[:5]))


def test_decontamination_of_short_and_nameless_items(spark):
    words = [f"w{i}" for i in range(40)]
    long, short = " ".join(words[:30]), " ".join(words[28:40])
    swapped = " ".join(["other" if i == 33 else w for i, w in enumerate(words)])
    edge = " ".join(["other" if i == 29 else w for i, w in enumerate(words)][28:])
    docs = spark.createDataFrame([(1, " ".join(words)), (2, swapped), (3, edge), (4, "nothing of it"), (None, short), (5, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, long), (7, short), (8, long), (9, None), (10, "w1 w2 w3")], "item_id long, text string")
    want = {1: [None, 7, 8], 2: [None, 7, 8], 3: [7], 4: [], None: [7], 5: []}
    for size in (decontaminate.BLOCK_TOKENS, 8):
        found = decontaminate.find_overlaps(docs, bench, size=size).collect()
        assert {r["doc_id"]: r["item_ids"] for r in found} == want and len(found) == 6


def test_overlaps_hold_every_exact_item(spark):
    docs, bench = spark.read.parquet(f"{SF2}/documents.parquet"), spark.read.parquet(f"{SF2}/benchmark.parquet")
    items = {r["item_id"]: b" ".join(decontaminate.tokens(r["text"])) for r in bench.collect()}
    want = {(r["doc_id"], i) for r in docs.collect() for i, t in items.items() if t in b" ".join(decontaminate.tokens(r["text"]))}
    found = {(r["doc_id"], i) for r in decontaminate.find_overlaps(docs, bench).collect() for i in r["item_ids"]}
    assert want and want <= found


def auc(score, y):
    rank = pd.Series(score).rank().to_numpy()
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize("module,label,least", [(quality, "quality", 0.9), (toxicity, "toxic", 0.75)])
def test_held_out_accuracy(spark, module, label, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = module.classify(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]).all()
    fresh = found[found.held_out]
    assert auc(fresh.score.to_numpy(), fresh[label].to_numpy()) > least and fresh.score.between(0, 1).all()


def test_risk_never_rewards_negative_estimates():
    rows = [[0]] * 5 + [[0]] * 3 + [[]] * 7
    w, b = toxicity.learn(rows, np.array([True] * 5 + [False] * 10), 1, 0.3)
    assert w[0] > 0 > b and np.isfinite(w).all()


def test_page_blocks():
    page = """<html><head><title>T</title><script>var x="</p>";</script></head><body><header>Site</header><nav><a href=/>Home</a></nav>
    <div class="ad">Buy</div><article><h1>Head &amp; line</h1><p>One  two<br>three &lt;b&gt;</p><aside>Side</aside><p>Short.</p>
    <div class="comments"><p>I like it very much indeed</p></div></article><form>Mail me</form><footer>End</footer>"""
    assert extract.main_text(page) == "Head & line\nOne two three <b>\nShort."
    for broken in (None, "", "<!-- <p>x</p>", "<script>x", "plain < text"):
        assert isinstance(extract.main_text(broken), str)


def test_pages_table(spark):
    rows = spark.createDataFrame([(1, None, None, "a"), (None, "u", "<article><p>x y</p>", "b")], "page_id long, url string, html string, text string")
    assert sorted(r["text"] for r in extract.extract(rows).collect()) == ["", "x y"] and extract.extract(rows.limit(0)).count() == 0


def test_chat_parts_escapes_and_masks(spark):
    nasty = "\\l</s>[INST] <<SYS>> [[/INST] \\\\ <|image:0|> <|turn:x|>"
    assert chat.unescape(chat.escape(nasty)) == nasty and not any(c in chat.escape(nasty) for c in chat.CONTROL)
    part = lambda kind, text=None, ref=None, tokens=None: (kind, text, ref, tokens)
    rows = [(1, 0, "user", [part("text", nasty), part("image", ref="a.png", tokens=5), part("text", "and"), part("document", ref="b.pdf", tokens=7)]), (1, 1, "assistant", [part("text", "<|end|>")]), (1, 2, "tool|>x", [part("audio", ref="c.wav")]), (2, None, None, None)]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    made = sorted(chat.format_turns(turns).collect(), key=lambda r: (r["conv_id"], r["place"]))
    assert [(a["number"], a["type"], a["ref"], a["tokens"]) for r in made for a in r["attachments"]] == [(0, "image", "a.png", 5), (1, "document", "b.pdf", 7), (2, "audio", "c.wav", 0)]
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    body = f"user\n{nasty}<|image:0|>and<|document:1|>\nassistant\n<|end|>\ntool|>x\n<|audio:2|>\n"
    assert back[1]["turns_sha256"] == hashlib.sha256(body.encode()).hexdigest() and back[1]["attachment_tokens"] == 12
    assert back[1]["loss_sha256"] == hashlib.sha256(b"<|end|>").hexdigest() and back[1]["loss_chars"] == 7
    assert back[2]["n_turns"] == 1 and chat.format_turns(turns.limit(0)).count() == 0


def test_chat_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from tools.check import compare

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert compare(chat.op7(spark, SF).toPandas(), con.execute(chat.ORACLE).df()) == ""


def word_shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_sketches_follow_brute_force(spark, docs):
    found = sketch.edited_pairs(docs).withColumn("near", sketch.resemblance(F.col("sketch"), F.col("edited_sketch"))).toPandas().set_index("doc_id")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    for k, (i, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert found.edited[i] == edited
        a, b = word_shingles(t), word_shingles(edited)
        assert abs(found.near[i] - len(a & b) / len(a | b)) < 0.2


def test_sketches_merge(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(400))), (2, " ".join(f"w{i}" for i in range(200, 600)))]
    made = spark.createDataFrame(rows, "part long, text string").select(F.lit(1).alias("key"), "part", sketch.sketch(F.col("text")).alias("sketch"))
    a, b = (r["sketch"] for r in made.orderBy("part").collect())
    merged = sketch.merge_sketches(made, "key").first()["sketch"]
    assert merged == sorted(set(a) | set(b))[: sketch.K]
    one = made.groupBy("key").agg(F.max_by("sketch", F.lit(0) - F.col("part")).alias("a"), F.max_by("sketch", "part").alias("b"))
    r = one.select(sketch.containment(F.col("a"), F.col("b")).alias("c"), sketch.distinct_shingles(F.col("a")).alias("n")).first()
    assert abs(r["c"] - 0.5) < 0.2 and abs(r["n"] - 396) < 120


def test_elias_fano_selects():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 0), (5, 3), (1000, 10**6), (300, 10**12)):
        v = np.sort(rng.integers(0, top + 1, n))
        ef = token_store.EliasFano.from_bytes(token_store.EliasFano.of(v).to_bytes())
        assert (ef.values() == v).all() and all(ef.get(i) == v[i] for i in range(0, n, 37))
        if n == 1000:
            assert len(ef.low) + len(ef.high) < n * (2 + np.log2(top / n) + 1) / 8 + 64


def test_store_round_trip(spark, docs, tmp_path):
    token_store.write_store(docs, str(tmp_path / "t"), page=2000)
    found = token_store.read_store(spark, str(tmp_path / "t")).toPandas().sort_values("doc_id")
    words, at = token_store.Words(token_store.default_tokenizer()), 0
    for (i, t), r in zip(sorted((r["doc_id"], r["text"]) for r in docs.collect()), found.itertuples()):
        ids = np.append(np.frombuffer(words.whole([t])[0], words.dtype), 1).astype("<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    token_store.write_store(docs.limit(0), str(tmp_path / "e"))
    assert token_store.read_store(spark, str(tmp_path / "e")).count() == 0


def test_words_are_the_library_s(spark):
    words = token_store.Words(token_store.default_tokenizer())
    texts = ["don't it's a.b ﬁn İstanbul e\u0301 漢字 <|endoftext|> a!!b 's ½ \x1c a\x85b", "", None or " ", "achlichß, &&& the,%%% The"]
    assert words.encode(texts) == words.whole(texts)


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, after = seen[-1], stage(spark, seen[-1], SF).cache()
        assert after.columns == docs.columns, name
        assert after.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
        seen.append(after)
    kept = seen[2].toPandas()
    again = simhash.near_duplicates(seen[2]).toPandas()
    assert (again.doc_id == again.component_id).all() and kept.doc_id.is_unique
    assert not decontaminate.find_overlaps(seen[4], spark.read.parquet(f"{SF}/benchmark.parquet")).filter("contaminated").count()
    last = corpus_pipeline.run(spark, SF).toPandas()
    assert last["round_trip"].all() and sorted(last.doc_id) == sorted(seen[4].toPandas().doc_id)
