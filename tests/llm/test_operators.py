"""Operators against brute force, library results or round trips, on small frames with every odd case."""

import random
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from cairn.llm import bpe, compression, language, lm, nearest, token_files
from cairn.llm.mixing import mix_sources
from cairn.llm.quality_rules import quality_cascade
from cairn.llm.sharding import assign_shards
from cairn.llm.simhash import simhash_components

ODD = [(None, None), (1, ""), (2, " \n\t "), (3, "Hello WORLD é<|endoftext|> a  b"), (3, "Hello WORLD é<|endoftext|> a  b"), (4, "x" * 5000), (5, "the cat sat on the mat " * 300), (6, None), (7, "the cat sat on the mat " * 299 + "the dog"), (8, "日本語 \U0001f600")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if k % 2 else None, "s" if k < 7 else None, 0, "clash") for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").cache()


def test_bpe_equals_library(docs):
    library = Tokenizer.from_file(bpe.default_vocabulary())
    for r in bpe.encode_texts(docs, decoded=True).collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["token_ids"]), "<u4").tolist() == ids
        assert r["decoded_text"] == library.decode(ids, skip_special_tokens=False) == (r["text"] or "")


def test_decode_ids(docs):
    coded = bpe.encode_texts(docs, keep=["text"])
    assert all(r["decoded_text"] == (r["text"] or "") for r in bpe.decode_ids(coded).collect())


def test_token_files_round_trip(docs):
    folder, index = token_files.token_files(docs, shard_bytes=64)
    library = Tokenizer.from_file(bpe.default_vocabulary())
    want = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), zlib.crc32(np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4"))) for r in docs.collect())
    got = sorted(token_files.read_checksums(index).collect(), key=lambda r: r["start"])
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["ids_crc32"]) for r in got) == want
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    ids = [r["doc_id"] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])


def test_fixed_length_sequences(tmp_path):
    uri = f"file://{tmp_path}/t/a.arrow"
    writer = token_files.ShardWriter(uri, 8, 2, 50256)
    assert [writer.add(np.arange(n, dtype="<u4")) for n in (5, 40, 0, 3)] == [0, 5, 45, 45]
    writer.close()
    reader = token_files.ShardReader(uri, 2)
    flat, mask = (np.concatenate([np.asarray(reader.sequence(s)[i]) for s in range(6)]) for i in (0, 1))
    assert flat[:48].tolist() == [*range(5), *range(40), *range(3)] and mask.tolist() == [1] * 48
    assert np.concatenate(list(reader.chunks(5, 40))).tolist() == list(range(40))


def test_library_encoder_by_pieces():
    rng = random.Random(1)
    mine = token_files.LibraryEncoder(bpe.default_vocabulary())
    letters = list(" \n\t'slldrevm  aé中1²!?<|>\U0001f600\r\x0b\x1c\x85_٣")
    texts = ["".join(rng.choices(letters, k=rng.randrange(24))) for _ in range(3000)]
    for x in [*texts, *(t.encode("ascii", "ignore").decode() for t in texts), "a<|endoftext|> b", "x" * 1000]:
        assert mine.encode(x) == np.array(mine.coder.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes(), x


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("block", [4096, 3])
def test_simhash_components(docs, block):
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash_components(docs, block=block).collect()}
    prints = [(r["doc_id"], slow_fingerprint(r["text"])) for r in docs.collect()]
    group = list(range(len(prints)))
    for _ in prints:
        for i, (_, x) in enumerate(prints):
            group[i] = min(group[j] for j, (_, y) in enumerate(prints) if (x ^ y).bit_count() <= 4)
    for i, (d, x) in enumerate(prints):
        least = min((e for j, (e, _) in enumerate(prints) if group[j] == group[i] and e is not None), default=None)
        assert got[d, f"{x:016x}"] == least


def test_language(spark, docs):
    texts = {"en": "the weather is nice and the dog runs ", "de": "das wetter ist schön und der hund läuft "}
    train = spark.createDataFrame([(i, t * (i % 3 + 1), lang) for i in range(6) for lang, t in texts.items()], "doc_id long, text string, lang string")
    prototypes = language.learn_prototypes(train)
    got = {r["text"]: (r["lang_pred"], r["score"]) for r in language.identify(train.union(docs.select("doc_id", "text", "lang")), prototypes).collect()}
    assert all(got[t][0] == lang for lang, t in texts.items())
    assert got[None] == got[""] == got[" \n\t "] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    assert language.learn_prototypes(train.limit(0)) == {}
    assert {r["lang_pred"] for r in language.identify(docs, {}).collect()} == {"und"}


def test_compression(docs):
    good, bad = "the weather is nice and the dog runs in the park number ", "@@@ BUY ### NOW $$$ CHEAP %%% "
    rng = np.random.default_rng(1)
    rows = [(" ".join(rng.permutation((good if y else bad).split())) * 3, y) for _ in range(40) for y in (0, 1)]
    model = compression.fit(rows)
    score = model.scorer()
    p = [(model.probability(score(t)) >= 0.5) == bool(y) for t, y in rows]
    assert np.mean(p) > 0.95
    assert all(0 <= r["score"] <= 1 for r in compression.score_quality(docs, model).collect())
    assert compression.fit([]).probability(0.3) == 0.5


def test_lattice_sums_all_segmentations():
    lat = lm.Lattice({"▁": -1.0, "a": -2.0, "b": -1.5, "ab": -2.5, "▁a": -3.0}, [-9.0] * 256, -0.5)
    forward, s = [1.0] + [0.0] * 3, "▁ab"
    for end in range(1, 4):
        forward[end] = sum(forward[i] * np.exp({"▁": -1.0, "a": -2.0, "b": -1.5, "ab": -2.5, "▁a": -3.0}.get(s[i:end], -np.inf)) for i in range(end)) + forward[end - 1] * np.exp(-9.0 * len(s[end - 1].encode()))
    assert lat.log_probability(b"ab") == pytest.approx(np.log(forward[3]) - 0.5)


def test_lm_base_score(docs):
    from collections import Counter

    from pyspark.sql import functions as F

    train = F.col("doc_id") != 7
    got = sorted(map(tuple, lm.score_texts(docs, train).select("doc_id", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6), "score").collect()), key=str)
    counts = Counter()
    for i, t in ODD:
        if i is not None and i != 7:
            counts.update([*lm.words_of(t), b""])
    n, v = counts.total(), len(counts)
    want = []
    for i, t in ODD:
        tokens = [*lm.words_of(t), b""]
        want.append((i, len(tokens), sum(counts[w] > 0 for w in tokens), n, round(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), 6)))
    for g, w in zip(got, sorted(want, key=str)):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], abs=1e-5) and g[5] < 0


def test_nearest_recall_and_odd_vectors(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 16))
    x[50:120] = x[50]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(20, [float(c) for c in x[20]]), (500, None), (520, [0.0] * 16), (540, [float("nan")] * 16), (560, [None] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.search(df, F.col("vec_id") % 20 == 0).toPandas()
    hits = 0
    for q in range(0, 400, 20):
        s = x @ x[q]
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 20 and q not in set(mine.vec_id)
        assert list(zip(-mine.score.round(9), mine.vec_id)) == sorted(zip(-mine.score.round(9), mine.vec_id))
        hits += len({i for i in sorted(range(400), key=lambda i: (-s[i], i)) if i != q} & set(mine.vec_id) & set(sorted([i for i in range(400) if i != q], key=lambda i: (-s[i], i))[:20]))
    assert hits >= 0.9 * 400 and set(got.query_id) == set(range(0, 400, 20))
    assert nearest.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_odd_frames_and_empty_tables(docs, empty):
    rows = docs.limit(0) if empty else docs
    n = 0 if empty else len(ODD)
    for f in (assign_shards, mix_sources, quality_cascade, simhash_components, bpe.encode_texts, lambda d: token_files.read_checksums(token_files.token_files(d)[1]), lambda d: lm.score_texts(d, d["doc_id"] > 2)):
        assert len(f(rows).collect()) == n


def test_mix_comes_near_its_targets(docs):
    got = mix_sources(docs).toPandas()
    for _, g in got.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max() and (g.taken <= 3 * g["size"]).all()


def test_labelled_sample(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (3, "c" * 100), (4, "d"), (None, "e"), (6, "f")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1), (4, 0), (4, 1), (None, 1), (5, 1), (6, 2), (3, None)], "doc_id long, quality int")
    rows, totals = compression.labelled_sample(docs, labels, "quality", 10)
    assert rows == [("a", 1), (None, 0), ("c" * 100, 1)] and totals == (1, 3)
    assert compression.labelled_sample(docs.union(docs), labels, "quality", 10)[0] == rows
    assert len(compression.labelled_sample(docs, labels, "quality", 1)[0]) <= 2
    assert compression.labelled_sample(docs, labels, "quality", 10, bytes_each=50)[0] in ([("a", 1), (None, 0)], [(None, 0)])
    assert compression.labelled_sample(docs.limit(0), labels, "quality", 10)[0] == []
    assert compression.labelled_sample(docs, labels.limit(0), "quality", 10) == ([], (0, 0))


def test_scores_keep_the_labels_share():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    text = lambda y: " ".join(rng.choice(words[: 220] if y else words[80:], 60))
    rows = [(text(y), y) for _ in range(120) for y in (0, 1)]
    even, odd = compression.fit(rows), compression.fit(rows, (1000, 9000))
    assert odd.slope == even.slope and odd.base - even.base == pytest.approx(np.log(9))


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="byte-level"):
        bpe.ByteBpe(public_tokenizers.path("word_bpe_49k.json"))
    whole = token_files.LibraryEncoder(public_tokenizers.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert np.frombuffer(whole.encode("Hello  World"), "<u4").tolist() == library.encode("Hello  World", add_special_tokens=False).ids


def test_word_encoder_in_arrays():
    import pyarrow as pa

    rng = random.Random(8)
    letters = list("  \n\t'slldrevm  aé中1²!?<|>\U0001f600\r\x0b\x1c\x85_٣　​")
    texts = ["".join(rng.choices(letters, k=rng.randrange(30))) for _ in range(4000)] + [None, "", " ", "  ", "a<|endoftext|> b", "x" * 1000, "\n \n x"]
    library = Tokenizer.from_file(bpe.default_vocabulary())
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for coder in (token_files.LibraryEncoder(bpe.default_vocabulary()), bpe.ByteBpe(bpe.default_vocabulary()).words):
        flat, ends = coder.encode_array(pa.array(texts))
        assert [x.tolist() for x in np.split(flat, ends[:-1])] == want
        assert [len(x) for x in np.split(flat, ends[:-1])] == list(map(len, want))
    mine = bpe.ByteBpe(bpe.default_vocabulary())
    assert mine.decode_all(flat, ends) == [t or "" for t in texts]


def test_shards_by_table(spark):
    from cairn.llm.sharding import fill

    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (None, "c", "z"), (1, "d", "w")], "doc_id long, _slot0 string, Shard string")
    got = assign_shards(rows).collect()
    table = fill([f"shard-{i:02d}" for i in range(16)], 2039)
    import hashlib

    for r in got:
        slot = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:15], 16) % 2039
        assert (r["slot"], r["shard"]) == (slot, f"shard-{table[slot]:02d}")
    assert sorted(r["_slot0"] for r in got) == list("abcd")
    assert max(np.bincount(table)) - min(np.bincount(table)) <= 1
    moved = np.mean(np.array(fill([f"s{i}" for i in range(15)], 2039)) != np.array(fill([f"s{i}" for i in range(16)], 2039)))
    assert moved < 0.25


def test_mix_caps_and_reshares(spark):
    sizes = {"a": 100, "b": 1000, "c": 10}
    rows = [(i, " ".join(["w"] * 10), s) for s, n in sizes.items() for i in range(n // 10)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas().groupby("source").target.first()
    # Weights 1, 2, 3 of 1,110 words: 185, 370, 555; c stops at 30, the rest goes 1 to 2: 360, over a's 300; b has the rest.
    assert dict(got) == {"a": pytest.approx(300), "b": pytest.approx(780), "c": pytest.approx(30)}


def test_language_odd_cases(spark, docs, monkeypatch):
    train = spark.createDataFrame([(1, "abc abc", "x"), (2, "abc abc", "y"), (3, "12 !", "z"), (4, None, "z")], "doc_id long, text string, lang string")
    prototypes = language.learn_prototypes(train)
    assert sorted(prototypes) == ["x", "y"]
    assert {r["lang_pred"] for r in language.identify(train.where("doc_id < 3"), prototypes).collect()} == {"x"}
    assert language.identify(docs.limit(0), prototypes).count() == 0
    monkeypatch.setattr(language, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError, match="more than 1 languages"):
        language.learn_prototypes(train)


def test_nearest_of_repeated_ids_and_lengths(spark):
    from pyspark.sql import functions as F

    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (1, [0.0, 3.0]), (2, [1.0, 1.0]), (3, [5.0]), (20, [2.0]), (4, [4.0, 0.0])]
    df = spark.createDataFrame([(i, v, "clash", 9) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int")
    got = sorted(map(tuple, nearest.search(df, F.col("vec_id") % 20 == 0, k=2).collect()))
    assert got == [(0, 1, 4, 4.0), (0, 2, 1, 3.0), (20, 1, 3, 10.0)]


def test_two_token_runs(docs):
    runs = [sorted(map(tuple, token_files.read_checksums(token_files.token_files(docs)[1]).select("start", "n_tokens", "ids_crc32").collect())) for _ in range(2)]
    assert runs[0] == runs[1]


def test_cascade_agrees_with_all_rules(docs):
    from cairn.llm.quality_rules import RULES, TextView

    for r in quality_cascade(docs, measures=True).collect():
        assert r["kept"] == (not any(rule.fails(TextView(r["text"])) for rule in RULES))
        assert r["kept"] == (r["failed_rule"] is None) and not (r["base_failed"] and r["kept"])


def test_sweep(spark):
    import os

    from cairn import folders

    table = folders.written(spark.range(3).toDF("x"), "sweep")
    path = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path)
    folders.sweep(spark)
    assert not os.path.exists(path)
