"""What each operator does with repeated rows, missing ids, clashing names, invalid bytes; brute force where a rule fixes the result."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sigtrace.llm import langid, mixing, near_vectors, packing, quality, queries, sharding, topk, toxicity
from sigtrace.llm.common import among_equals

DATA = "/root/testdata/sf0.01"


def test_equal_rows_are_divided_by_bytes(spark):
    rows = spark.range(4000).selectExpr("cast(null as long) doc_id", "'same text' text", "id k1", "'mine' k2", "9 shard")
    out = sharding.shard_by_bytes(sharding.digest(rows).withColumns({"k1": F.lit(4), "k2": F.lit("mine")}), 8, "text_hash", "doc_id", "size").toPandas()
    assert out.groupby("shard").size().tolist() == [500] * 8
    assert all(sorted(g) == list(range(500)) for _, g in out.groupby("shard").slot)
    assert (out.k1 == 4).all() and (out.k2 == "mine").all()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_splitters_against_sorted_keys(spark, seed):
    rng = np.random.default_rng(seed)
    n = 3000
    group = np.where(rng.random(n) < 0.33, 5, rng.integers(0, 400, n))
    size = rng.integers(1, 2000, n)
    rows = spark.createDataFrame(list(zip(range(n), group.tolist(), size.tolist(), strict=True)), "id long, g long, size long")
    out = sharding.shard_by_bytes(rows, 7, "g", "id", "size").toPandas()
    total = out.groupby("shard")["size"].sum()
    assert len(out) == n and (total - size.sum() / 7).abs().max() <= size.max() + 0.002 * size.sum() / 7
    # A group lies in one shard, or in neighbours that a splitter parted.
    spans = out.groupby("g").shard.agg(["min", "max", "nunique"])
    assert (spans["max"] - spans["min"] + 1 == spans["nunique"]).all() and (spans["nunique"] > 1).sum() <= 6


def plain_targets(sizes):
    """Targets by the rule's own words: shares by weight, what is above three times a size is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    fixed = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in fixed)
        among = sum(weight[s] for s in order if s not in fixed)
        share = {s: 3 * sizes[s] if s in fixed else left * weight[s] / among for s in order}
        above = {s for s in order if s not in fixed and share[s] > 3 * sizes[s]}
        if not above:
            return share
        fixed |= above


@pytest.fixture(scope="module")
def uneven(spark):
    """Sources of very unlike sizes, missing ids and sources, rows that repeat, empty and null texts."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(6000):
        source = rng.choice(["a", "b", "c", "d", None], p=[0.05, 0.6, 0.25, 0.04, 0.06])
        if i % 3 == 0:
            rows.append((None, "w " * 9, "b"))
        else:
            rows.append((i if i % 5 else None, [None, "", "x " * int(rng.integers(1, 60))][min(2, int(rng.integers(0, 40)))], source))
    return spark.createDataFrame([(d, t, s, "own", 1) for d, t, s in rows], "doc_id long, text string, source string, draws string, target int")


def test_targets_are_met_to_a_document(uneven):
    out = mixing.mixed(uneven, 8).toPandas()
    size = uneven.toPandas().text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    assert len(out) == len(size) and out["size"].sum() == size.sum()
    out["taken"] = out["size"] * out.copies
    sizes = {None if s != s else s: int(g["size"].sum()) for s, g in out.groupby("source", dropna=False)}
    want = plain_targets(sizes)
    for s, g in out.groupby("source", dropna=False):
        s = None if s != s else s
        assert g.target.iloc[0] == pytest.approx(want[s]) and g.source_size.iloc[0] == sizes[s]
        assert abs(g.taken.sum() - want[s]) <= g["size"].max() and g.copies.max() <= 3
        assert [len(d) for d in g.draws] == g.copies.tolist()


def test_the_tree_decides_what_is_taken(spark, uneven):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    a, b, c = (mixing.mixed(docs, 16, seed, narrow=True).toPandas().set_index("doc_id").copies.sort_index() for seed in (1, 1, 2))
    assert (a == b).all() and (a != c).mean() > 0.1
    # The same order of blocks, other quotas: other blocks are drawn.
    x, y = (mixing.leaf_draws(100, np.array(q)) for q in ((30, 10, 0), (10, 10, 20)))
    drawn = [{k for mine, _ in z for k in mine} for z in (x, y)]
    assert len(drawn[0]) == len(drawn[1]) == 40 and drawn[0] != drawn[1]
    assert sorted(k for mine, rest in x for k in (*mine, *rest)) == list(range(100))


def test_tables_read_in_other_parts_give_the_same_mix(uneven):
    a, b = (mixing.mixed(t, 8).groupBy("doc_id", "source", "text").agg(F.sum("copies").alias("n")).collect() for t in (uneven, uneven.repartition(7)))
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_whole_passes_draw_every_block_once_and_shards_are_even():
    quotas = np.array([64, 64, 17, 40])
    leaf = mixing.splitting_tree(quotas, 16, np.random.default_rng(3))
    assert (leaf.sum(axis=0) == quotas).all() and np.ptp(leaf.sum(axis=1)) <= 1
    assert [b for mine, rest in mixing.leaf_draws(64, leaf[:, 0]) for b in mine] == list(range(64))


def test_names_that_clash_stay(uneven):
    out = mixing.mix(uneven, 4)
    assert out.columns == [*uneven.columns, "out_shard", "shuffle_key"] and {r[0] for r in out.select("draws").distinct().collect()} == {"own"}


def test_numbers_among_equals(spark):
    rows = spark.range(1000).repartition(5).selectExpr("case when id % 3 = 0 then 7 else id div 2 end k", "id")
    got = among_equals(rows, "k").toPandas()
    assert len(got) == 1000 and all(sorted(g) == list(range(len(g))) for _, g in got.groupby("k")["__nth"])


def test_factor_sum_against_all_pairs():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 9):
        v = rng.normal(size=(n, 4))
        assert toxicity.interactions(v) == pytest.approx(sum(float(v[i] @ v[j]) for i in range(n) for j in range(i)))


def exclusive(n=4000, a=1007, b=1009):
    """Rows of common terms; the label is 1 where exactly one of two terms is there, so neither alone says anything."""
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for _ in range(n):
        one, two = rng.random(2) < 0.5
        rows.append(np.unique(np.concatenate([rng.choice(180, 30, replace=False), [a] * int(one), [b] * int(two)]).astype(np.int64)))
        labels.append(int(one != two))
    return rows, np.array(labels)


def test_terms_that_tell_only_together_are_learned():
    rows, labels = exclusive()
    assert {1007, 1009} <= set(toxicity.telling(rows, labels, np.arange(len(rows))))
    model = toxicity.train(rows[:3000], labels[:3000], np.ones(3000))
    z = np.array([model.slope * model.margin(r) + model.shift for r in rows[3000:]])
    assert ((z > 0) == labels[3000:]).mean() >= 0.95


def test_pairs_against_plain_sums():
    rng = np.random.default_rng(6)
    n = 600
    x = (rng.random((n, 12)) < rng.uniform(0.1, 0.9, 12)).astype(int)
    y = ((x[:, 2] != x[:, 5]) ^ (rng.random(n) < 0.2)).astype(int)
    found = np.zeros(toxicity.BUCKETS)
    found[:12] = x.sum(axis=0)
    want = set()
    for i in range(12):
        for j in range(i):
            parts = [(c - c.mean()) / c.std() for c in (x[:, i], x[:, j], y)]
            if abs(sum(a * b * c for a, b, c in zip(*parts, strict=True))) / n**0.5 >= toxicity.PAIR_ERRORS:
                want |= {i, j}
    assert set(toxicity.telling_pairs([np.flatnonzero(r) for r in x], y, found)) == want == {2, 5}


def slopes(value, arrays, at=1e-6):
    """Gradient of value() by central differences in every entry of arrays."""
    out = []
    for a in arrays:
        g = np.zeros_like(a)
        for i in np.ndindex(a.shape):
            keep = a[i]
            a[i] = keep + at
            up = value()
            a[i] = keep - at
            g[i] = (up - value()) / (2 * at)
            a[i] = keep
        out.append(g)
    return out


def small_net():
    rng = np.random.default_rng(3)
    p, u = rng.normal(1, 1, (7, 5)), rng.normal(0, 1, (11, 5))
    return p, u, [rng.normal(size=(5, 3)), rng.normal(size=3), rng.normal(size=3), rng.normal(size=1)]


@pytest.mark.parametrize(("prior", "sign"), [(0.2, 1), (2.0, -1)])
def test_quality_risk_and_gradient_against_sums_and_differences(prior, sign):
    p, u, par = small_net()

    def parts():
        score = lambda x: 1 / (1 + np.exp(-sum(par[2][h] * np.tanh(sum(x[i] * par[0][i, h] for i in range(5)) + par[1][h]) for h in range(3)) - par[3][0]))
        sp, su = [score(x) for x in p], [score(x) for x in u]
        return prior * sum(1 - s for s in sp) / 7, sum(su) / 11 - prior * sum(sp) / 7

    plus, negative, grads = quality.step(par, p, u, prior)
    assert (plus, negative) == pytest.approx(parts()) and negative * sign > 0
    goal = (lambda: sum(parts())) if negative >= 0 else (lambda: -parts()[1])
    for got, want in zip(grads, slopes(goal, par), strict=True):
        assert got == pytest.approx(want, abs=1e-6)


def test_language_loss_and_gradient_against_sums_and_differences():
    rng = np.random.default_rng(7)
    mean, weight, labels, balance = rng.normal(size=(6, 4)), rng.normal(size=(4, 3)), rng.integers(0, 3, 6), rng.uniform(0.5, 2, 6)

    def value():
        out = 0.0
        for m, y, b in zip(mean, labels, balance, strict=True):
            logits = [sum(m[i] * weight[i, c] for i in range(4)) for c in range(3)]
            out -= b * (logits[y] - np.log(sum(np.exp(v) for v in logits)))
        return out / 6

    got, *grads = langid.loss(mean, weight, labels, balance)
    assert got == pytest.approx(value())
    for g, want in zip(grads, slopes(value, [mean, weight]), strict=True):
        assert g == pytest.approx(want, abs=1e-6)


def test_words_are_letters_alone():
    assert langid.words_of("\u00bd \u00b2 \u2167 12") == []
    assert langid.words_of("x\u00b2y Stra\u00dfe_1\u00e9t\u00e9") == ["x", "y", "stra\u00dfe", "\u00e9t\u00e9"]


@pytest.fixture(scope="module")
def damaged(spark):
    """Invalid UTF-8 in every text column, missing ids, an id that a third of all rows share."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(300)
    bad = F.expr("cast(concat(cast(text as binary), X'FF20C3') as string)")
    more = docs.withColumns({"text": bad, "source": F.expr("cast(X'FFFE' as string)"), "doc_id": F.lit(None).cast("long")})
    same = docs.withColumns({"doc_id": F.lit(5).cast("long"), "lang": F.lit("en")})
    return docs.unionByName(more).unionByName(same).withColumns({"__scored": F.lit("mine"), "toxic_score": F.lit("x")})


def test_invalid_bytes_and_repeated_ids_in_classifiers(spark, damaged):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").unionByName(spark.createDataFrame([(5, 1, 0), (5, 1, 0), (5, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    docs = damaged.drop("__scored")
    rows, y, weights = toxicity.sampled_terms(docs, labels, "toxic", 4000)
    known = {r["doc_id"] for r in labels.where("toxic is not null and doc_id is not null").collect()}
    ids = {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
    assert len(rows) == len(known & ids) + 1 and len(rows) == len(y) == len(weights)  # 5 is labelled twice over
    scored = toxicity.toxicity(docs, toxicity.train(rows, y, weights))
    assert scored.where("toxic_score between 0 and 1").count() == 900 and scored.columns[-2:] == ["toxic_score", "toxic"]
    assert quality.quality(docs, quality.fit(docs, labels)).where("quality_score between 0 and 1").count() == 900
    out = langid.identify(docs, langid.fit(docs)).select("doc_id", "lang_pred", F.hex("source").alias("raw")).toPandas()
    assert len(out) == 900 and (out.raw == "FFFE").sum() == 300


def test_samples_have_a_bound_by_rows(spark):
    rows = spark.range(3000).selectExpr("cast(null as long) doc_id", "concat('wort', id % 50) text", "'de' lang")
    assert 1 <= len(langid.fit(rows, per_class=10).classes) <= 1
    many = spark.range(2000).selectExpr("id doc_id", "concat('wort', id) text", "concat('l', id % 400) lang")
    assert len(langid.fit(many, per_class=1000).classes) == 400


def test_no_letter_is_undetermined(spark):
    model = langid.fit(spark.read.parquet(f"{DATA}/documents.parquet"))
    rows = spark.createDataFrame([("\u00bd \u00b2 \u2167",), (None,), ("",), ("123 ...",)], "text string")
    assert {r["lang_pred"] for r in langid.identify(rows, model).collect()} == {"und"}
    assert queries.op8_language_id.__doc__


@pytest.mark.parametrize("seed", [1, 2])
def test_search_with_repeated_ids_and_ties_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    rng = np.random.default_rng(seed)
    ids, x = rng.integers(0, 150, 400), rng.integers(-2, 3, (400, 6)) / 256
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)]
    rows += [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (7, [1.0, 2.0])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.pmod("vec_id", F.lit(50)) == 0).collect()
    q = [np.floor(256 * np.array(v)).astype(int) for _, v in rows]
    want = []
    for a, (i, _) in enumerate(rows):
        if i % 50 == 0:
            scores = sorted((-int(q[a] @ q[b]), j) for b, (j, _) in enumerate(rows) if b != a and len(q[a]) == len(q[b]))[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)


def test_bounds_hold_and_prune(capsys):
    import duckdb

    df = duckdb.sql("SELECT vec_id, embedding FROM '/root/testdata/sf0.1/embeddings.parquet' ORDER BY vec_id").df()
    x = np.floor(256 * np.stack(df.embedding).astype(float)).astype(np.int64)
    q, nums = x[::50], np.arange(len(x))
    score = q @ x.T
    score[np.arange(len(q)), nums[::50]] = -(1 << 40)
    low = topk.floors(nums[::50], q, nums, x, 5)
    assert (low == np.sort(score, axis=1)[:, -5]).all()
    for turn in (topk.plain_turn(x.shape[1]), topk.fitted_turn(x.astype(float))):
        alive = topk.survivors(q, x, low, turn)
        assert all((a | ~b).all() for a, b in zip(alive, alive[1:], strict=False))
        assert alive[-1][score >= low[:, None]].all()  # nothing that belongs to the answer is lost
        with capsys.disabled():
            print("share alive after each resolution:", [round(float(a.mean()), 4) for a in alive])
        assert alive[-1].mean() < 0.3
    # Where energy lies in few directions, the turn lets coarse segments prune.
    rng = np.random.default_rng(0)
    y = np.floor(256 * rng.normal(size=(3000, 8)) @ rng.normal(size=(8, 64))).astype(np.int64)
    low = topk.floors(nums[:50], y[:50], np.arange(3000), y, 5)
    plain, turned = (topk.survivors(y[:50], y, low, t)[0].mean() for t in (topk.plain_turn(64), topk.fitted_turn(y.astype(float))))
    with capsys.disabled():
        print("share alive after the coarsest resolution:", round(float(plain), 3), "turned:", round(float(turned), 3))
    assert turned < 0.1 < plain


def test_packing_replaces_clashing_names_and_moves_few_numbers(spark):
    rows = [(i % 3, "word " * (37 * i % 5000), "x", 1, "mine") for i in range(60)] + [(None, None, None, None, None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string, piece int, filled string")
    out = packing.pack_documents(docs, keep=("doc_id", "offset", "piece", "filled"), with_ids=True)
    got = out.toPandas()
    assert out.columns == ["doc_id", "filled", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    assert (got.piece == 0).sum() == 65 and got.filled.isna().sum() == 5 and (got.ids.map(len) == 4 * got.length).all()
    s = got.sort_values(["sequence_id", "offset"])
    assert (s.groupby("sequence_id").length.cumsum() - s.length == s.offset).all() and s.groupby("sequence_id").length.sum().max() <= 2048


def test_blocks_of_packing_give_each_piece_one_place(spark):
    rows = spark.range(900).selectExpr("id % 7 a", "cast(1 + id * 37 % 2047 as long) length")
    out = packing.pack(rows, 2048, block_pieces=200).toPandas()
    assert sorted(zip(out.a, out.length, strict=True)) == sorted((i % 7, 1 + i * 37 % 2047) for i in range(900))
    s = out.sort_values(["sequence_id", "offset"])
    assert (s.groupby("sequence_id").length.cumsum() - s.length == s.offset).all() and s.groupby("sequence_id").length.sum().max() <= 2048


def test_near_vectors_with_repeated_ids_and_ties(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 2.0, 0.0]), (3, [0.0, 0.0, 1.0]), (3, [0.0, 0.0, 1.0]), (4, [0.01, 0.0, 5.0]), (0, [-1.0, 0.0, 0.0])]
    got = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(0, 0, 0, True), (1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False)]


def test_links_at_the_very_threshold(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 3))
    x = np.concatenate([x, x + rng.normal(size=(60, 3)) * 0.15])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas().set_index("vec_id").sort_index()
    near = u @ u.T >= 0.95
    assert got.n_links.tolist() == (near.sum(axis=1) - 1).tolist()
    root = np.arange(len(x))
    for _ in range(len(x)):
        root = np.array([root[n].min() for n in near])
    assert got.component_id.tolist() == root.tolist()


def test_every_stage_takes_awkward_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, toxic string, __text string, length long"
    texts = spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], None, 1, "own", "own", 2) for r in texts]
    rows += [(None, None, None, None, None, None, None, None, None), (5, "", "en", "a", 0, 0, "", "", 0), (5, " \t", None, None, 0, 0, "", "", 0)]
    rows += [(7, texts[0]["text"], "en", None, 1, 1, "x", "y", 1)] * 2 + [(None, texts[1]["text"], None, "b", 1, 1, "x", "y", 1), (8, texts[2]["text"] * 40, "en", "b", 1, 1, "x", "y", 1)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, DATA)
            kept = out.collect()
            assert name == "pack" or out.columns == table.columns
            if name == "pack":
                assert sum(r["piece"] == 0 for r in kept) == table.count()
            elif not table.isEmpty():
                assert 0 < len(kept) <= 3 * len(rows)
            else:
                assert not kept
