"""Each operator against brute force, held-out labels, exact round trips and awkward tables."""

import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sigtrace.llm import langid, mixing, near_vectors, packing, quality, queries, sharding, simhash, token_counts, topk, toxicity
from sigtrace.llm.common import fold, shared_dir
from sigtrace.llm.components import components
from sigtrace.llm.tokens import Encoder, spaced, vocabulary

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, lang_pred string, toxic_score double, target double"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{DATA}/documents.parquet' ORDER BY doc_id").df().set_index("doc_id")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing extra columns."""
    rng = random.Random(1)
    words = ["the", "and", "house", "trash", "loser", "el", "perro", "der", "Hund", "été"]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    rows = [(1, "one two three four five six", "en", "a"), (1, "one two three four five six", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \t\n", "en", "b"), (5, long, "en", None), (6, long, "de", "b"), (None, "no id here at all", "en", "a"), (7, "x" * 300_000, "en", "b"), (8, "loser trash the house", "en", "b"), (9, "ééé 日本語 👍 <|endoftext|>", "fr", "c")]
    return spark.createDataFrame([(*r, None, 5, 3, "clash", 0.5, 1.0) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def reference_fingerprint(text, words):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    s = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(s))


def test_sharding_law_slots_and_groups(spark, docs):
    out = queries.op1_histogram_sort(spark, DATA).toPandas().set_index("doc_id").sort_index()
    assert (out["size"] == docs.text.map(lambda t: len(t.encode()) + 1)).all()
    assert (out.text_crc32 == docs.text.map(lambda t: zlib.crc32(t.encode()))).all()
    total = out.groupby("shard")["size"].sum().reindex(range(16))
    assert (total - total.mean()).abs().max() <= out["size"].max()
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard").slot)


def test_sharding_divides_a_heavy_group(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("g"), F.lit(10).cast("long").alias("size"))
    n = sharding.shard_by_bytes(rows, 8, "g", "id", "size").groupBy("shard").count().toPandas()["count"]
    assert len(n) == 8 and n.max() - n.min() <= 2


def test_mix_targets(spark, docs):
    out = queries.op2_source_mix(spark, DATA).toPandas().set_index("doc_id").sort_index()
    assert (out["size"] == docs.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))).all()
    g = out.assign(source=docs.source).groupby("source")
    assert abs(g.target.first().sum() - out["size"].sum()) < 1e-3
    assert ((g.taken.sum() - g.target.first()).abs() <= g["size"].max()).all()
    assert (out.taken <= 3 * out["size"]).all()
    again = queries.op2_source_mix(spark, DATA).toPandas().set_index("doc_id").sort_index()
    assert (again.taken == out.taken).all()


def test_targets_respect_the_limit():
    out = mixing.targets({"a": 10, "b": 10, None: 1000})
    assert out["b"] == 30 and sum(out.values()) == pytest.approx(1020)


def test_splitting_tree_is_exact():
    q = np.array([5, 0, 100, 33])
    leaves = mixing.splitting_tree(q, 7, np.random.default_rng(0))
    assert (leaves.sum(axis=0) == q).all() and np.ptp(leaves.sum(axis=1)) <= 1 and (leaves >= 0).all()


def test_mix_shards_are_balanced(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = mixing.mix(docs, shards=4)
    assert set(out.columns) == {*docs.columns, "out_shard", "shuffle_key"}
    n = out.groupBy("out_shard").count().toPandas()["count"]
    assert len(n) == 4 and n.min() > 0.3 * n.max()


def test_token_counts_across_blocks(spark, docs, tmp_path):
    enc = Encoder(vocabulary(), plain_specials=True)
    where = str(tmp_path / "tokens")
    names = token_counts.write_flat(spark.read.parquet(f"{DATA}/documents.parquet").repartition(3), where)
    out = token_counts.count_tokens(token_counts.flat_files(spark, where, names), block_ids=500)
    assert out.where("ended").count() == out.count() == len(docs)
    out = names.join(out, ["file_id", "ordinal"]).toPandas().set_index("doc_id")
    assert out.file_id.nunique() == 3
    assert out.n_tokens.sort_index().tolist() == [len(enc.ids(t.encode())) for t in docs.text]
    assert (out.sort_values("ordinal").groupby("file_id").ordinal.diff().dropna() == 1).all()
    # The files hold nothing but ids: each document's, and the end id.
    for path in (tmp_path / "tokens").glob("*.ids"):
        mine = out[out.file_id == int(path.name[:6])].sort_values("ordinal")
        want = np.concatenate([np.append(enc.ids(docs.text[d].encode()), token_counts.END_ID) for d in mine.index])
        assert path.read_bytes() == want.astype("<u2").tobytes()


def test_files_that_no_row_lists_do_not_count(spark, tmp_path):
    where = str(tmp_path / "tokens")
    names = token_counts.write_flat(spark.createDataFrame([(1, "one two"), (None, None)], "doc_id long, text string").coalesce(1), where)
    (tmp_path / "tokens" / "000000-lost.ids").write_bytes(b"\1\0\xff\xc0")
    out = token_counts.count_tokens(token_counts.flat_files(spark, where, names)).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["n_tokens"]) for r in out] == [(0, 2), (1, 0)]


@pytest.mark.parametrize(("block", "group"), [(3, 1024), (1, 2), (4, 1), (100, 1024)])
def test_token_files_without_a_last_separator(spark, tmp_path, monkeypatch, block, group):
    monkeypatch.setattr(token_counts, "GROUP_BLOCKS", group)
    rng, want = np.random.default_rng(block), set()
    files = {"a": [1, 2, 9, 9, 3, 4, 5, 9, 6], "b": [], "c": [7] * 20, "d": [9, 9], "e": rng.integers(5, 10, 200).tolist()}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes() + b"\7" * (name == "a"))
        start = 0
        for i, x in enumerate([*ids, None]):
            if x == 9 or x is None and start < len(ids):
                want.add((name, ids[:start].count(9), start, i - start, x == 9))
                start = i + 1
    listed = token_counts.flat_files(spark, str(tmp_path))
    out = token_counts.count_tokens(listed, end_id=9, block_ids=block).join(listed, "file_id").collect()
    assert {(r["path"][-1], r["ordinal"], r["start"], r["n_tokens"], r["ended"]) for r in out} == want and len(out) == len(want)


def test_encoder_equals_the_tokenizer(docs):
    from tokenizers import Tokenizer

    plain, enc = Tokenizer.from_file(vocabulary()), Encoder(vocabulary())
    for t in [*docs.text[:200], "it's I'll 'll Å é é <|endoftext|> x<|endoftext|>y", "a.b ...c —.d x 　y", "½ ² 日本語 👨‍👩‍👧"]:
        assert enc.ids(t.encode()).tolist() == plain.encode(t, add_special_tokens=False).ids


def test_letters_alone_go_to_the_model(docs):
    """Pieces of lower letters pass no other step of the tokenizer, and have its ids; marks are set apart as a regex would."""
    enc = Encoder(vocabulary())
    whole, calls = enc.tokenizer, []

    class Counted:
        def encode(self, piece, **given):
            calls.append(piece)
            return whole.encode(piece, **given)

    enc.tokenizer = Counted()
    rng = np.random.default_rng(4)
    words = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(1, 60, 500)] + ["s", "ll", "ve", "x" * 5000]
    words += ["".join(map(chr, rng.choice([*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)], n))) for n in rng.integers(1, 30, 500)]
    for word in [*words, *(w.upper() for w in words[:50]), "the, dog.", "the×÷"]:
        assert enc.ids(word.encode()).tolist() == whole.encode(word, add_special_tokens=False).ids, word
    assert set(calls) <= {",", ".", "the×÷"}
    for text in [b"", b".", b"a", b"a.", *(bytes(rng.choice(list(b"aZ.,!?;: \n9\xc3\xa9'"), n)) for n in range(1, 200))]:
        assert spaced(text) == re.sub(rb"(?<=[A-Za-z])(?=[.,!?;:])", b" ", text)


def test_other_vocabularies_are_encoded_whole():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    plain, enc = Tokenizer.from_file(path), Encoder(path)
    text = "Two  Words, a\tTab\n\nand MORE."
    assert not enc.by_pieces and Encoder(vocabulary()).by_pieces and enc.ids(text.encode()).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(spark, docs):
    out = packing.pack_documents(spark.read.parquet(f"{DATA}/documents.parquet"), with_ids=True).toPandas()
    enc = Encoder(vocabulary())
    for doc, g in out.sort_values("piece").groupby("doc_id"):
        assert b"".join(g.ids) == np.append(enc.ids(docs.text[doc].encode()), 0).astype("<u4").tobytes()
        assert (g.length[:-1] == 2048).all() and (g.ids_crc32 == g.ids.map(zlib.crc32)).all()
    s = out.sort_values(["sequence_id", "offset"])
    assert (s.groupby("sequence_id").length.cumsum() - s.length == s.offset).all()
    filled = s.groupby("sequence_id").length.sum()
    assert filled.max() <= 2048 and len(filled) <= -(-out.length.sum() // 2048) * 1.02 + 1


def test_sum_of_squares_places_where_the_sum_is_least():
    lengths, capacity = np.random.default_rng(2).integers(1, 10, 300), 10
    bins, offsets = packing.sum_of_squares(lengths, capacity)
    gaps: dict[int, int] = {}
    for s, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        cost = lambda g: sum(n * n for n in np.bincount([x for x in g if 0 < x < capacity], minlength=capacity))
        options = [cost([*(v for k, v in gaps.items() if k != c), v0 - s]) for c, v0 in gaps.items() if v0 >= s] + [cost([*gaps.values(), capacity - s])]
        assert o == capacity - gaps.get(b, capacity)
        gaps[b] = gaps.get(b, capacity) - s
        assert gaps[b] >= 0 and cost(gaps.values()) == min(options)


def test_simhash_against_all_pairs(spark, docs):
    out = queries.op9_simhash_near_dedup(spark, DATA).toPandas().set_index("doc_id").sort_index()
    for i in list(docs.index)[::40]:
        assert int(out.fingerprint[i], 16) == reference_fingerprint(docs.text[i], 3)
    fp = np.array([int(x, 16) for x in out.fingerprint], np.uint64)
    root = np.arange(len(fp))
    a, b = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None]) <= 2)
    for _ in range(len(fp)):
        before = root.copy()
        np.minimum.at(root, a, root[b])
        if (before == root).all():
            break
    assert (out.index.to_numpy()[root] == out.component_id).all()


def test_crowded_blocks_link_what_all_pairs_link(spark):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    fps = list({base ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4]))) for _ in range(500)} | {rng.getrandbits(64) for _ in range(200)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), crowd=8)).toPandas()
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(fps):
        for j in range(i):
            if (x ^ fps[j]).bit_count() <= 2:
                parent[find(signed[i])] = find(signed[j])
    groups: dict[int, set] = {}
    for x in signed:
        groups.setdefault(find(x), set()).add(x)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(g) for g in got.groupby("root").node.apply(list)}


def test_similar_documents_against_all_pairs(spark, docs):
    rng = random.Random(6)
    extra = []
    for i, t in enumerate(t for t in docs.text[:300] if len(t.split()) > 150):
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        extra.append((10_000 + i, " ".join(w)))
    rows = [*docs.text.items(), *extra]
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id").component_id
    sets = {i: frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) for i, t in rows for w in [t.lower().split()]}
    links = [(a, b) for n, (a, x) in enumerate(sets.items()) for b, y in list(sets.items())[:n] if 0.8 * len(x) <= len(y) <= 1.25 * len(x) and len(x & y) >= 0.8 * len(x | y)]
    assert len(links) > 100 and np.mean([got[a] == got[b] for a, b in links]) >= 0.98
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert all(got[i] >= find(i) for i in sets)  # nothing is joined that should stay apart


def test_topk_against_brute_force(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.floor(256 * np.stack(df.embedding).astype(float)).astype(np.int64), df.vec_id.to_numpy()
    got = queries.op5_exact_topk(spark, DATA).toPandas().sort_values(["query_id", "rank"])
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        best = sorted((-int(s[i]), int(ids[i])) for i in range(len(ids)) if i != q)[:5]
        assert [(-r.score, r.vec_id) for r in got[got.query_id == ids[q]].itertuples()] == best


def test_topk_awkward_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 0.0]), (6, []), (7, [1.0]), (None, [1.0, 1.0]), (8, [-1.0, 0.0])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 5 * 65536), (8, -65536)]
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0


def test_near_vectors_recall(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(1500, 32))
    near = base[0] + rng.normal(size=(400, 32)) * 0.12
    x = np.concatenate([base, near, base[:50] * 3, base[:50]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = near_vectors.near_vectors(df, cap=300).toPandas().sort_values("vec_id")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (u @ u.T >= 0.95).sum(axis=1) - 1
    assert (got.n_links.to_numpy() <= true).all() and got.n_links.sum() >= 0.95 * true.sum()
    assert got.kept.sum() == (got.component_id == got.vec_id).sum() and got.kept.sum() <= 1500


def test_near_vectors_lose_no_pair(spark, monkeypatch):
    """Pairs on borders of shards, of a dense group's edge and of shards that cannot be cut: all links, none left to recall."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=(1000, 48))
    near = base[:600] + rng.normal(size=(600, 48)) * 0.31
    group = base[0] + rng.normal(size=(300, 48)) * rng.uniform(0.05, 0.4, size=(300, 1))
    x = np.concatenate([base, near, group, base[:20] * 2, base[:20]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(near_vectors, "PART", 32768, raising=False)
    got = near_vectors.near_vectors(df, cap=60).toPandas().sort_values("vec_id")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    alike = u @ u.T >= 0.95
    assert got.n_links.tolist() == (alike.sum(axis=1) - 1).tolist()
    root = np.arange(len(x))
    while (root != (now := np.array([root[n].min() for n in alike]))).any():
        root = now
    assert got.component_id.tolist() == root.tolist()


def test_near_vectors_awkward(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 0.0]), (None, [1.0, 0.0]), (6, [1.0]), (7, [1.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[0] == (2, 0, True) and got[1] == (2, 0, False) and got[7] == (2, 0, False) and got[2] == (0, 2, True) and got[3] == (0, 3, True) and got[6] == (0, 6, True) and got[None][0] == 0
    assert near_vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_classifiers_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    lang = queries.op8_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (lang.lang == lang.lang_pred).mean() > 0.99 and lang.rejected.mean() < 0.01
    good = queries.op10_quality_pu(spark, d).join(labels, "doc_id").where("held_out").toPandas()
    assert (good.predicted == good.quality).mean() > 0.93
    bad = queries.op4_toxicity_fm(spark, d).join(labels, "doc_id").where("held_out").toPandas()
    assert bad[bad.toxic == 1].predicted.mean() > 0.75 and bad[bad.toxic == 0].predicted.mean() < 0.02


def test_unknown_scripts_are_rejected(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.fit(docs.where(fold("doc_id", 3) != 1))
    rows = spark.createDataFrame([("Привет мир, это простой текст",), ("12 34 !!",), (None,)], "text string")
    assert [r["lang_rejected"] for r in langid.identify(rows, model).collect()] == [True, True, True]


def test_awkward_tables(spark, odd, empty, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (8, 0, 1), (7, None, None), (8, 0, 1)], "doc_id long, quality int, toxic int")
    for table, n in ((odd, 11), (empty, 0)):
        assert sharding.shard_by_bytes(sharding.digest(table), 16, "text_hash", "doc_id", "size").count() == n
        assert mixing.mixed(table).count() == n
        assert set(mixing.mix(table).columns) == {*table.columns, "out_shard", "shuffle_key"} and mixing.mix(table).count() >= 0
        where = str(tmp_path / f"tokens{n}")
        names = token_counts.write_flat(table, where)
        assert names.count() == n and token_counts.count_tokens(token_counts.flat_files(spark, where, names), block_ids=1000).count() == n
        assert packing.pack_documents(table).where("piece = 0").count() == n
        assert simhash.near_duplicates(table).count() == n
        assert simhash.similar_documents(table).count() == n
        model = langid.fit(table.where("lang is not null"))
        assert langid.identify(table, model).count() == n and langid.identify(table, model).columns.count("lang_pred") == 1
        tox = toxicity.toxicity(table, toxicity.fit(table, labels))
        assert tox.count() == n and tox.columns.count("toxic_score") == 1
        assert tox.where("toxic_score between 0 and 1").count() == n
        assert quality.quality(table, quality.fit(table, labels)).where("quality_score between 0 and 1").count() == n
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(odd).where("doc_id is not null").collect()}
    assert groups[2] == groups[3] == groups[4] == 2 and groups[6] == 5 and groups[9] == 9


def test_pipeline_stages(spark, docs):
    sf = DATA
    table = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    now = table
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        assert name == "pack" or now.columns == table.columns
        now = spark.createDataFrame(now.collect(), now.schema)
        kept[name] = now.toPandas()
    assert len(kept["language"]) >= 0.99 * len(docs)
    first = kept["near_copies"].text.map(lambda t: " ".join(t.lower().split()))
    assert first.is_unique and set(kept["near_copies"].doc_id) <= set(kept["toxicity"].doc_id)
    assert set(kept["mix"].doc_id) <= set(kept["near_copies"].doc_id) and kept["mix"].doc_id.value_counts().max() <= 3
    assert len(kept["pack"][kept["pack"].piece == 0]) == len(kept["mix"])


def test_one_of_each_group_stays(spark):
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(5, text), (3, text.upper()), (3, text.upper()), (9, text.replace("word7 ", "other ")), (None, text), (4, "something else entirely"), (4, "something else entirely")]
    out = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r["doc_id"] for r in out if r["doc_id"] is not None) in ([3, 4], [4]) and len(out) == 2


def grouped(got, sets, least=0.8):
    """Whether the groups are those that all pairs of sets at least so similar form."""
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return all(got[i] == find(i) for i in ids)


def five(text):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def test_near_copies_behind_looser_relatives(spark):
    rng = random.Random(8)
    base = [f"word{i}" for i in range(400)]

    def edited(w, n):
        w = list(w)
        for k in rng.sample(range(len(w) // 10), n):
            w[10 * k + 5] = f"x{rng.getrandbits(40)}"
        return w

    family = [edited(base, 6) for _ in range(120)]  # 30 of 396 shingles each: mostly below 0.8 of each other
    family += [edited(w, 1) for w in family[-40:]]
    rows = [(i, " ".join(w)) for i, w in enumerate(family)]
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id").component_id
    sets = {i: five(t) for i, t in rows}
    assert grouped(got, sets)
    assert 1 < got.nunique() <= 120


def test_near_copies_cut_extended_or_patched(spark, docs):
    texts = [t.split() for t in docs.text if len(t.split()) > 40][:150]
    rows = []
    for i, w in enumerate(texts):
        other, n = texts[i - 1], len(w)
        spot = n // 3
        copies = (w, w[: int(0.84 * n)], w + (other * n)[: int(0.18 * n)], w[:spot] + (other * n)[: int(0.07 * n)] + w[spot + int(0.07 * n) :])
        rows += [(10 * i + j, " ".join(c)) for j, c in enumerate(copies)]
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id").component_id
    assert grouped(got, {i: five(t) for i, t in rows}) and got.nunique() < 0.5 * len(rows)


def test_rows_that_share_an_id_go_by_their_own_text(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(100)) for w in ("one", "two", "three"))
    rows = [(1, one), (7, one + " more"), (7, two), (8, three), (8, three), (8, "quite another text")]
    out = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, out)) == sorted([(1, one), (7, two), (8, three), (8, "quite another text")])


def test_pipeline_mix_is_in_shuffled_order(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(300)
    want = [r["doc_id"] for r in mixing.mix(docs).orderBy("out_shard", "shuffle_key").select("doc_id").collect()]
    assert [r["doc_id"] for r in corpus_pipeline.mix(spark, docs, "").collect()] == want != sorted(want)


def test_near_copies_by_fingerprint(spark):
    refrain = " ".join(f"word{i}" for i in range(21))
    rows = [(i, " ".join([refrain] * 40 + [f"{x}{j}" for j in range(10)])) for i, x in ((1, "one"), (2, "two"))] + [(3, "quite another text")]
    a, b = (simhash.fingerprint(t.encode()) for _, t in rows[:2])
    assert (a ^ b).bit_count() <= 2 and len(five(rows[0][1]) & five(rows[1][1])) < 0.6 * len(five(rows[0][1]) | five(rows[1][1]))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert len({r["component_id"] for r in simhash.near_duplicates(table).collect()}) == 2
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, table, "").collect()) == [1, 3]


def test_near_copies_keep_every_link_of_both_kinds(spark, docs):
    texts = [t.split() for t in docs.text if len(t.split()) > 40][:60]
    rows = [(10 * i + j, " ".join(c)) for i, w in enumerate(texts) for j, c in enumerate((w, w[: int(0.84 * len(w))], [*w[:5], "changed", *w[6:]], w[: int(0.6 * len(w))]))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.similar_rows(table, distance=2).toPandas().set_index("doc_id").component_id
    sets, fp = {i: five(t) for i, t in rows}, {i: simhash.fingerprint(t.encode()) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(sorted(sets)):
        for b in sorted(sets)[:n]:
            if (fp[a] ^ fp[b]).bit_count() <= 2 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert all(got[i] == find(i) for i in sets)


def test_near_copies_leave_no_work_tables(spark, docs):
    where = shared_dir(spark)
    rows = [(i, t) for i, t in list(docs.text.items())[:200]] + [(10_000 + i, t + " more words") for i, t in list(docs.text.items())[:50]]
    before = set(os.listdir(where))
    corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert {x.split("-")[0] for x in set(os.listdir(where)) - before} <= {"unsure"}


def _tasks(spark, group, run):
    """What run returns, and how many tasks its jobs had in all."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    state = spark.sparkContext.statusTracker()
    stages = {s for j in state.getJobIdsForGroup(group) for s in state.getJobInfo(j).stageIds}
    return out, sum(x.numCompletedTasks for s in stages if (x := state.getStageInfo(s)))


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_links_join_alike_in_one_task_and_in_rounds(spark, few):
    rng = random.Random(5)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 2000 + i) for i in range(40)] + [(7, 7), (None, 3), (-(1 << 63), (1 << 63) - 1)]
    root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in root:
        for u, v in edges:
            if u in root and v in root and u != v:
                root[u] = root[v] = min(root[u], root[v])
    got = [tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long"), few=few).collect()]
    assert len(got) == len(root) and dict(got) == root
    assert components(spark.createDataFrame([], "u long, v long"), few=few).count() == 0


def test_small_rounds_do_not_multiply_tasks(spark, docs, monkeypatch):
    """The rounds over a few members and links cost tasks of the driver's memory, however many partitions a shuffle has."""
    texts = [" ".join(f"w{i}x{j % (60 + i % 3)}" for j in range(i % 7, 60)) + f" tail{i}" for i in range(40)] + [f"one two three four five six {i} " + " ".join(f"{i}y{j}" for j in range(30)) for i in range(60)]
    texts += [t + " and more" for t in texts[::3]] + [t.replace("y7", "z7") for t in texts[1::5]]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got, tasks = _tasks(spark, "few", lambda: sorted(map(tuple, simhash.similar_rows(table, distance=2).collect())))
        monkeypatch.setattr(simhash, "FEW", 0)
        spread, many = _tasks(spark, "spread", lambda: sorted(map(tuple, simhash.similar_rows(table, distance=2).collect())))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == spread and len({g[2] for g in got}) < len(texts)
    print("tasks", tasks, "spread", many)
    assert 2 * tasks < many


def test_families_of_unlike_texts_give_few_pairs(spark, monkeypatch):
    """Texts that share rare shingles but are not similar: the join rules their pairs out, so few have to be verified."""
    rng = np.random.default_rng(21)
    made = rng.choice(3, size=(150, 110), p=[0.88, 0.06, 0.06])
    texts = [" ".join(f"w{k}v{v}" for k, v in enumerate(row)) for row in made]
    texts += [t + " more" for t in texts[:10]]
    met, real = [], simhash.linked_by_keys

    def counted(members, similar, *rest):
        def look(pairs):
            met.append(pairs.count())
            return similar(pairs)

        return real(members, look, *rest)

    monkeypatch.setattr(simhash, "linked_by_keys", counted)
    got = simhash.similar_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().set_index("doc_id").component_id
    assert sum(met) <= 40
    assert [got[i] for i in range(160)] == [*range(150), *range(10)]
