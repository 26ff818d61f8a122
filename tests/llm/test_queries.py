"""The registered queries against SQL and against plain Python, at sf0.001 and on odd tables."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from cairn.llm import bpe, compression, language, lm, nearest, registry, simhash
from cairn.llm.oracles import ORACLES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_simhash": ["doc_id", "fingerprint", "component_id"],
    "op2_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op3_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op4_sharding": ["doc_id", "slot", "shard"],
    "op5_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op6_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op7_nearest": ["query_id", "rank", "vec_id", "score"],
    "op8_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op9_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op10_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
}


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def found(spark):
    return {name: registry.QUERIES[name](spark, SF).toPandas() for name in COLUMNS}


def same(ours, theirs):
    assert sorted(ours.columns) == sorted(theirs.columns) and len(ours) == len(theirs)
    cell = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    flat = lambda p: sorted(tuple(map(cell, r)) for r in p[sorted(p.columns)].itertuples(index=False))
    assert flat(ours) == flat(theirs)


def test_columns_and_rows(found, docs):
    for name, columns in COLUMNS.items():
        assert list(found[name].columns) == columns, name
        if name != "op7_nearest":
            assert sorted(found[name].doc_id) == sorted(r["doc_id"] for r in docs), name
    for name, n, held in (("op2_quality_classifier", 3, 1), ("op3_language", 4, 2), ("op9_lm_scoring", 7, 2)):
        assert all(h == (fold(i, n) == held) for i, h in zip(found[name].doc_id, found[name].held_out))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(found, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    same(found[name], con.execute(ORACLES[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_on_odd_rows(spark, tmp_path, name):
    rows = [(None, None, None), (1, "", "s"), (1, "", "s"), (2, " \n\t ", "t"), (3, "Ab # c\n" * 60, "s"), (4, "x y z " * 40, None), (None, "word " * 3, "u"), (5, "é ü ß " * 30, "u")]
    spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    ours, theirs = registry.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(ORACLES[name]).fetchdf()
    same(ours.astype(str), theirs.astype(ours.dtypes.to_dict(), errors="ignore").astype(str))


def test_simhash_query(found, docs):
    prints = {}
    for r in docs:
        words = r["text"].encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
        prints[r["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    group = {i: i for i in prints}
    changed = True
    while changed:
        least = {i: min(group[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4) for i in prints}
        changed, group = least != group, least
    got = found["op1_simhash"]
    assert {i: (f, c) for i, f, c in got.itertuples(index=False)} == {i: (f"{prints[i]:016x}", group[i]) for i in prints}


def test_quality_query(found, docs):
    texts = {r["doc_id"]: r["text"] for r in docs}
    rows = [(r["doc_id"], r["quality"]) for r in pq.read_table(f"{SF}/labels.parquet").to_pylist() if r["quality"] in (0, 1) and r["doc_id"] in texts and fold(r["doc_id"], 3) != 1]
    model = compression.fit([(texts[i], y) for i, y in sorted(rows)])
    feature = model.scorer()
    for i, _, score, predicted in found["op2_quality_classifier"].itertuples(index=False):
        assert score == pytest.approx(1 / (1 + math.exp(-model.slope * feature(texts[i]) - model.base)), abs=1e-12)
        assert predicted == (score >= 0.5) and 0 <= score <= 1


def test_language_query(found, docs):
    def vector(text):
        spaced = f" {language._GAPS.sub(' ', text).lower()} "
        if not any(map(str.isalpha, spaced)):
            return None
        total = np.zeros(language.DIMENSIONS)
        for gram, n in Counter(zip(spaced, spaced[1:], spaced[2:])).items():
            bound = np.ones(language.DIMENSIONS)
            for i, ch in enumerate(gram):
                bound *= np.roll(language.letter_vector(ord(ch)), 2 - i)
            total += n * bound
        return total / np.linalg.norm(total)

    vectors = {r["doc_id"]: vector(r["text"]) for r in docs}
    sums = {}
    for r in docs:
        if r["lang"] is not None and fold(r["doc_id"], 4) != 2 and vectors[r["doc_id"]] is not None:
            sums[r["lang"]] = sums.get(r["lang"], 0) + vectors[r["doc_id"]]
    names = sorted(sums)
    table = np.array([sums[n] / np.linalg.norm(sums[n]) for n in names])
    centre = table.mean(axis=0)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    for i, _, pred, score in found["op3_language"].itertuples(index=False):
        if vectors[i] is None:
            assert (pred, score) == ("und", 0.0)
            continue
        cos = unit(table - centre) @ unit(vectors[i] - centre)
        e = np.exp(language.SHARPNESS * cos)
        assert pred == names[int(cos.argmax())] and score == pytest.approx(float(e.max() / e.sum()), abs=1e-4)
    right = [r["lang"] == p for r, p in zip(sorted(docs, key=lambda r: r["doc_id"]), found["op3_language"].sort_values("doc_id").lang_pred) if r["lang"] and fold(r["doc_id"], 4) == 2]
    assert np.mean(right) > 0.9


def test_lm_query(found, docs):
    library = lm._library(lm.default_pieces())
    tokens = {r["doc_id"]: [*r["text"].encode().lower().split(), b""] for r in docs}
    c = Counter(w for i, t in tokens.items() if fold(i, 7) != 2 for w in t)
    n, v = c.total(), len(c)
    once, twice = (sum(x == k for x in c.values()) for k in (1, 2))
    d = once / (once + 2 * twice)
    uses = Counter()
    for w in c:
        if w:
            uses.update(library.encode(w.decode()))
            uses["stop"] += 1
    usable = [i for i in range(library.get_piece_size()) if not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
    total = uses.total() + len(usable) + 1
    of = {library.id_to_piece(i): (uses[i] + 1) / total for i in usable if not library.is_byte(i)}
    byte = [(uses[library.piece_to_id(f"<0x{b:02X}>")] + 1) / total for b in range(256)]

    def spelled(word):
        s = "▁" + word.decode()
        forward = [1.0] + [0.0] * len(s)
        for end in range(1, len(s) + 1):
            forward[end] = sum(forward[i] * of.get(s[i:end], 0.0) for i in range(end)) + forward[end - 1] * math.prod(byte[b] for b in s[end - 1].encode())
        return forward[-1] * (uses["stop"] + 1) / total

    memo = {w: math.log10(((c[w] - d if c[w] else 0) + d * v * spelled(w)) / n) if w else math.log10((c[w] - d) / n) for w in {w for i in list(tokens)[:60] for w in tokens[i]}}
    got = found["op9_lm_scoring"].set_index("doc_id")
    for i in list(tokens)[:60]:
        t, r = tokens[i], got.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), abs=1e-6)
        assert r.score == pytest.approx(sum(memo[w] for w in t), abs=1e-5 * len(t))


def test_bpe_and_token_queries(found, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    at, starts = 0, found["op10_token_files"].set_index("doc_id")
    mine = found["op8_bpe"].set_index("doc_id")
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        ids = library.encode(r["text"], add_special_tokens=False).ids
        raw, got, file = np.array(ids, "<u4").tobytes(), mine.loc[r["doc_id"]], starts.loc[r["doc_id"]]
        assert (got.n_tokens, got.ids_sha256) == (len(ids), hashlib.sha256(raw).hexdigest())
        assert got.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (file.start, file.n_tokens, file.ids_crc32) == (at, len(ids) + 1, zlib.crc32(raw + bytes(4)))
        at += len(ids) + 1


def test_nearest_query(found):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    x, ids = np.array([r["embedding"] for r in t], dtype=float), np.array([r["vec_id"] for r in t])
    got, hits, n = found["op7_nearest"], 0, 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        want = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21))
        assert np.allclose(mine.score, [s[ids == i][0] for i in mine.vec_id], atol=1e-12)
        hits, n = hits + len(set(want) & set(mine.vec_id)), n + 20
    assert hits >= 0.9 * n


@pytest.mark.parametrize("clustered", [False, True])
def test_partial_distances_abandon_vectors(clustered):
    rng = np.random.default_rng(5)
    if clustered:
        x = (rng.standard_normal((40, 64)) * 3)[rng.integers(0, 40, 8000)] + rng.standard_normal((8000, 64))
    else:
        x = rng.standard_normal((8000, 12)) @ rng.standard_normal((12, 64))
    lists = nearest.Lists(x, float((x * x).sum(axis=1).max()), len(x))
    turned = lists.turned(x)
    own, far = lists.nearest(turned)
    held = np.array([[f.size, f.mean(), f.var(), f.max()] if f.size else [0, 0, 0, 0] for f in (far[own == i] for i in range(len(lists.centroids)))]).T
    lists.measured(*held)
    y = lists.turned(x[:64], query=True)
    d = ((turned - y[:, None]) ** 2).sum(axis=2)
    k = 11
    probes = lists.probes(y, k)
    first, rest = [o[:f] for o, f in probes], [o[f:] for o, f in probes]
    one, two = nearest.Scanner(lists, k), nearest.Scanner(lists, k)
    everyone = np.ones(len(x), dtype=bool)
    p, q, e = one.scan(turned, own, everyone, y, first, np.full(64, np.inf))
    limits = np.array([np.sort(e[q == i])[k - 1] if (q == i).sum() >= k else np.inf for i in range(64)])
    p2, q2, _ = two.scan(turned, own, everyone, y, rest, limits)
    hits = sum(len(set(np.argsort(d[i])[:k]) & {*p[q == i], *p2[q2 == i]}) for i in range(64))
    assert hits >= 0.9 * 64 * k
    if clustered:  # few lists are asked at all
        assert sum(len(o) for o, _ in probes) < 0.3 * 64 * len(lists.centroids)
    else:  # of those asked with a limit, far from all components are read
        assert two.whole > 0 and two.read < 0.8 * two.whole


def test_components_of_a_star(spark):
    from cairn.llm.components import connected_components

    leaves = 100_000
    edges = spark.range(1, leaves + 1).selectExpr("id * 3 as u", "cast(0 as long) as v").union(spark.createDataFrame([(i + 1, i) for i in range(10**6, 10**6 + 70)], "u long, v long"))
    got = connected_components(edges)
    assert got.where("u < 1000000 and v = 0").count() == leaves and got.where("u > 1000000 and v = 1000000").count() == 70 and got.count() == leaves + 70


def test_long_texts(spark):
    text = " ".join(f"word{i % 977}," for i in range(400_000)) + "y" * 1_000_000
    rows = spark.createDataFrame([(1, text), (2, text), (3, "short")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.encode_texts(rows, decoded=True).collect()}
    from tokenizers import Tokenizer

    assert np.frombuffer(bytes(got[1]["token_ids"]), "<u4").tolist() == Tokenizer.from_file(bpe.default_vocabulary()).encode(text, add_special_tokens=False).ids
    assert got[2]["decoded_text"] == text
    assert {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(rows).collect()} == {1: 1, 2: 1, 3: 3}
