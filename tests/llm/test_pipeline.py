import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from cairn.llm import near
from cairn.llm.mixing import mix_hash, mix_sources

SF = "/root/testdata/sf0.001"


def test_pipeline_runs_whole(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert len(out) and out.intact.all() and set(out.doc_id) <= set(docs)
    assert out.groupby("doc_id").size().max() <= 3


def test_stages_take_empty_tables(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_near_duplicates_keep_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.near_duplicates(spark, docs.union(docs), SF)
    ids = [r["doc_id"] for r in kept.collect()]
    texts = duckdb.sql(f"SELECT count(DISTINCT text) FROM '{SF}/documents.parquet'").fetchall()[0][0]
    assert len(ids) == len(set(ids)) <= texts


def slow_shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("block", [1024, 3])
def test_near_components_link_at_similarity(spark, block):
    rng = random.Random(3)
    texts = [None, "", " \n", "a b", "A  b", "a c"]
    for n in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(120 + n)]
        texts.append(" ".join(words))
        for edits in (1, 3, 5, 8):
            copy = list(words)
            for at in rng.sample(range(len(copy)), edits):
                copy[at] = "edited"
            texts.append(" ".join(copy))
    sets = [slow_shingles(t or "") for t in texts]
    group = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(x & y) >= 4 * len(x | y) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    roots = {r["key"]: r["root"] for r in near.near_components(docs, block=block).collect()}
    keys = [r["k"] for r in docs.select("doc_id", near.text_key("text").alias("k")).orderBy("doc_id").collect()]
    got = [roots.get(k, k) for k in keys]
    assert all((got[i] == got[j]) == (group[i] == group[j]) for i in range(len(got)) for j in range(i))


def test_near_duplicates_drop_edited_copies(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(0, " ".join(words), "en", "s", 0), (1, " ".join(words[:100] + ["x", "y"] + words[102:]), "en", "s", 0), (2, " ".join(words[:100]), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == [0, 2]


def test_near_duplicates_keep_one_of_each_group(spark):
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    near_a = texts[0] + " more"
    rows = [(None, texts[0]), (None, near_a), (None, texts[1]), (None, texts[1]), (None, texts[2]), (7, texts[2]), (8, texts[3]), (8, near_a.replace("a", "e")), (9, texts[3] + " more"), (10, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    want = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (8, texts[3]), (8, near_a.replace("a", "e")), (10, None)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_language_stage_drops_texts_of_no_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(-1, "### q !!! 123", None, "s", 0), (-2, "%% 12", None, "s", 0), (-3, None, None, "s", 0), (-4, "ぬ %% ゑ ## ゐ", None, "s", 0)], docs.schema)
    ids = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs.union(odd), SF).collect()}
    assert min(ids) >= 0 and len(ids) >= 0.98 * docs.count()
    unlabelled = odd.union(docs.limit(5).selectExpr("doc_id", "text", "cast(null as string)", "source", "n_chars"))
    left = {r["doc_id"] for r in corpus_pipeline.language_id(spark, unlabelled, SF).collect()}
    assert {-1, -4} <= left and not left & {-2, -3}


def test_mixing_takes_each_row_by_its_own_count(spark):
    rows = [(None if i % 3 else 5, f"word {i} " * (i % 7 + 1), "en", f"s{i % 4}" if i % 5 else None, i) for i in range(60)]
    rows += rows[:10]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = Counter(r["mix_hash"] for r in mix_sources(docs).collect() for _ in range(r["copies"]))
    got = corpus_pipeline.mixing(spark, docs, SF).select(mix_hash("doc_id", "text").alias("h"))
    assert Counter(r["h"] for r in got.collect()) == taken and taken


def test_language_stage_fills_unknown_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    hidden = docs.where("lang is not null").limit(20)
    known = {r["doc_id"]: r["lang"] for r in hidden.collect()}
    blank = hidden.selectExpr("doc_id + 1000000 as doc_id", "text", "cast(null as string) as lang", "source", "n_chars")
    got = {r["doc_id"] - 10**6: r["lang"] for r in corpus_pipeline.language_id(spark, docs.union(blank), SF).where("doc_id >= 1000000").collect()}
    assert sum(known[i] == got.get(i) for i in known) >= 18


def test_stages_take_odd_rows_and_clashing_columns(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 80, None, None, 1), (None, "plain words in a line " * 20, "en", "t", None)]
    docs = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _key string, copies int, kept boolean")
    counts = [stage(spark, docs, SF).count() for _, stage in corpus_pipeline.STAGES]
    assert counts[0] == 2 and counts[2] == 3 and counts[4] == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == corpus_pipeline.COLUMNS


def test_pipeline_equals_brute_force(spark, tmp_path):
    import numpy as np
    from tokenizers import Tokenizer

    from cairn.llm import bpe, language
    from cairn.llm.oracles import ORACLES
    from cairn.llm.quality_rules import RULES, TextView

    docs = duckdb.sql(f"SELECT * FROM '{SF}/documents.parquet'").fetchdf().astype(object).where(lambda x: x.notna(), None).to_dict("records")
    profiler, sums = language.Profiler(), {}
    for r in docs:
        r["v"] = profiler.vector(r["text"])
        if r["lang"] is not None and r["v"] is not None:
            sums[r["lang"]] = sums.get(r["lang"], 0) + r["v"]
    names = sorted(sums)
    table = np.array([sums[n] / np.linalg.norm(sums[n]) for n in names])
    centre = table.mean(axis=0)
    docs = [r for r in docs if r["v"] is not None and (table @ r["v"]).max() >= language.CHANCE]
    for r in docs:
        shifted = (table - centre) / np.linalg.norm(table - centre, axis=1, keepdims=True) @ (r.pop("v") - centre)
        r["lang"] = r["lang"] or names[int(shifted.argmax())]
    docs = [r for r in docs if not any(rule.fails(TextView(r["text"])) for rule in RULES)]
    sets = [slow_shingles(r["text"]) for r in docs]
    group = list(range(len(docs)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if group[i] != group[j] and 5 * len(x & y) >= 4 * len(x | y):
                group = [group[j] if g == group[i] else g for g in group]
    kept = [min((r for r, g in zip(docs, group) if g == k), key=lambda r: r["doc_id"]) for k in sorted(set(group))]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    spark.createDataFrame([tuple(r[f.name] for f in schema) for r in kept], schema).coalesce(1).write.parquet(f"{tmp_path}/kept")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/kept/*.parquet'")
    times = {i: taken // size for i, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({ORACLES['op5_mixing']})").fetchall()}
    library, want = Tokenizer.from_file(bpe.default_vocabulary()), Counter()
    for r in kept:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        want[r["doc_id"], r["lang"], r["source"], len(ids), np.array(ids, "<u4").tobytes(), True] += times[r["doc_id"]]
    got = Counter((r["doc_id"], r["lang"], r["source"], r["n_tokens"], bytes(r["token_ids"]), r["intact"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == +want


def test_near_copies_are_found_by_positional_bytes(spark):
    rng = random.Random(5)
    sets = []
    for n in range(40):
        shared = [rng.getrandbits(64) for _ in range(80)]
        sets += [shared + [rng.getrandbits(64) for _ in range(10)] for _ in range(2)]
    prints = [near.fingerprint(near.np.array(s, dtype=near.np.uint64)) for s in sets]
    edges = set()
    for i, x in enumerate(prints):
        for j, y in enumerate(prints[:i]):
            for at in range(near.LISTS):
                if x[2 * at : 2 * at + 2] == y[2 * at : 2 * at + 2]:
                    a, b = ((p + p)[2 * at + 2 : 2 * at + 2 + 2 * near.SPAN] for p in (x, y))
                    same = sum(p == q for p, q in zip(a, b))
                    bits = sum((p ^ q).bit_count() for p, q in zip(a, b))
                    if same >= near.LEAST_BYTES and bits <= near.MOST_BITS:
                        edges.add((i, j))
    assert {(2 * i + 1, 2 * i) for i in range(40)} <= edges
    rows = spark.createDataFrame(list(enumerate(map(bytearray, prints))), "key long, print binary")
    for block in (4096, 3):
        assert {(r["u"], r["v"]) for r in near.link_prints(rows, block).collect()} == edges


def test_large_groups_meet_in_few_edges(spark):
    np, rng = near.np, random.Random(7)

    def group(n):
        shared = [rng.getrandbits(64) for _ in range(90)]
        return [near.fingerprint(np.array(shared + [rng.getrandbits(64) for _ in range(10)], dtype=np.uint64)) for _ in range(n)]

    prints = group(400) + [p for _ in range(30) for p in group(6)]
    lists, *carried = near.postings(np.frombuffer(b"".join(prints), dtype=np.uint8).reshape(len(prints), -1))
    linked = np.zeros((len(prints), len(prints)), dtype=bool)
    for at in range(near.LISTS):
        word = np.ascontiguousarray(np.stack([c[:, at] for c in carried], axis=1))
        x = (word[:, None] ^ word[None]).view(np.uint8)
        bits = np.bitwise_count(x).sum(axis=2, dtype=np.int64)
        linked |= (lists[:, None, at] == lists[None, :, at]) & ((x == 0).sum(axis=2) >= near.LEAST_BYTES) & (bits <= near.MOST_BITS)

    def closure(edges):
        label = list(range(len(prints)))
        for u, v in edges:
            if label[u] != label[v]:
                label = [label[v] if k == label[u] else k for k in label]
        return [label.index(k) for k in label]

    want = closure(np.argwhere(linked).tolist())
    assert want[:400] == [0] * 400 and len(set(want)) > 20
    rows = spark.createDataFrame(list(enumerate(map(bytearray, prints))), "key long, print binary")
    for block in (4096, 32):
        edges = [(r["u"], r["v"]) for r in near.link_prints(rows, block).collect()]
        assert closure(edges) == want
        assert all(u > v for u, v in edges) and len(set(edges)) == len(edges) <= 3 * len(prints)


def test_near_copies_met_in_all_lists_are_joined_once(spark, monkeypatch):
    rng, met = random.Random(8), []
    joined = near.connected_components
    monkeypatch.setattr(near, "connected_components", lambda edges: met.append(edges.count()) or joined(edges))
    words = [f"w{n}" for n in range(150)]
    texts = []
    for _ in range(500):
        copy = list(words)
        copy[rng.randrange(150)] = f"x{rng.getrandbits(32)}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for block in (1024, 50):
        met.clear()
        got = near.near_components(docs, block=block).collect()
        assert len(got) == 500 and len({r["root"] for r in got}) == 1
        assert max(met) <= 12 * 500


def test_bpe_remembers_within_its_bound():
    from cairn.llm import bpe

    rng = random.Random(6)
    texts = near.pa.array([" ".join(f"{rng.choice('abcdef')}{rng.randrange(300)}" for _ in range(50)) for _ in range(40)])
    free, bound = bpe.ByteBpe(bpe.default_vocabulary()), bpe.ByteBpe(bpe.default_vocabulary(), remembered=20_000)
    for at in range(0, 40, 4):
        a, b = (c.words.encode_array(texts.slice(at, 4)) for c in (free, bound))
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
        # One batch of at most 200 new words may lie above the bound.
        assert bound.words.held <= 20_000 + 200 * (bpe.ENTRY + 50)
    assert free.words.held > 100_000
