import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thicket.llm import knn, mix, pack, split, tokens


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n\U0001f642é", max_size=3000), st.integers(20, 400), st.integers(0, 15))
def test_cut_points_round_trip(text, limit, overlap):
    pieces = split.cut_points(text, limit, overlap)
    assert all(b - a <= limit for a, b in pieces) and pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(c == b - overlap and d > b for (_, b), (c, d) in zip(pieces, pieces[1:]))
    assert "".join([text[a + (overlap if i else 0) : b] for i, (a, b) in enumerate(pieces)]) == text


def test_last_piece_and_line_ends():
    for n in range(1540, 4000, 61):
        pieces = split.cut_points("ab cd. " * (n // 7), 1536, 192)
        assert all(b - a - (192 if i else 0) >= (1536 - 192) // 3 for i, (a, b) in enumerate(pieces)) or len(pieces) == 1
    codes = np.frombuffer("a\r\n\r\nb".encode("utf-32-le"), dtype=np.uint32)
    at, worth = split.boundaries(codes)
    assert dict(zip(at.tolist(), worth.tolist()))[5] == split.PARAGRAPH


def test_edit_changes_neighbours_only():
    r = np.random.default_rng(3)
    text = " ".join("".join(r.choice(list("abcdefgh"), r.integers(1, 9))) for _ in range(9000))
    edited = text[:4000] + "EDIT" + text[4000:]
    cut = lambda t: {t[a:b] for a, b in split.cut_points(t, 1536, 192)}
    assert len(cut(text) - cut(edited)) <= 4 and len(cut(text)) > 30


def test_split_frame(spark):
    df = spark.createDataFrame([("a", "x" * 10, 1), ("b", "y z\n" * 900, 2), ("c", None, 3), ("d", "", 4), ("b", "y z\n" * 900, 5), (None, "q", 6)], "id string, content string, piece int")
    out = split.split_oversized(df, "id", "content", 512, 64).collect()
    by = {}
    for r in out:
        by.setdefault(r["id"], []).append(r)
    assert len(by["a"]) == 1 and by["d"][0]["token_count"] == 0 and "c" not in by and len(by["b"]) == 2 * by["b"][0]["part_count"]
    assert all(r["token_count"] <= 512 and r["token_count"] == -(-len(r["piece"]) // 3) for r in out)
    assert split.split_oversized(df.limit(0), "id", "content", 512, 64).count() == 0


def brute(x, k):
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return np.sort(s, 1)[:, ::-1][:, :k]


def test_knn_against_brute_force(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((600, 64)).astype(np.float32)
    x[:200] = x[:1] + 0.05 * r.standard_normal((200, 64))
    x[200:260] = x[200] * r.uniform(0.5, 3, (60, 1))  # copies of one direction, more than k and than a block
    rows = [("c", f"id{i:04d}", v.tolist()) for i, v in enumerate(x)] + [("d", "only", [1.0] * 64), ("c", "zero", [0.0] * 64), ("c", "short", [1.0]), ("c", "nan", [math.nan] * 64), ("c", None, [1.0] * 64), ("c", "null", None)]
    df = spark.createDataFrame(rows, "collection string, id string, embedding array<float>")
    got = knn.all_neighbours(df, 5, 64, block_rows=64).toPandas()
    assert len(got) == 600 * 5 and set(got["collection"]) == {"c"} and (got["id"] != got["neighbour"]).all()
    want = brute(knn.unit(x), 5)
    mine = got.sort_values(["id", "rank"])["similarity"].to_numpy().reshape(600, 5)
    assert (mine >= want[:, -1:] - 1e-5).mean() > 0.9
    near = knn.all_neighbours(df, 5, 64, least=0.9, block_rows=64).toPandas()
    full = got[got["similarity"] >= 0.9]
    assert len(set(zip(full["id"], full["rank"])) - set(zip(near["id"], near["rank"]))) <= 0.1 * len(full)


def test_leaves_and_boxes():
    r = np.random.default_rng(4)
    x = r.standard_normal((1000, knn.M)).astype(np.float32)
    order = knn.leaf_order(x)
    assert sorted(order.tolist()) == list(range(1000)) and len(knn.leaf_order(x[:0])) == 0
    low, high = knn.boxes_of(x[order])
    assert len(low) == 4 and (low <= high).all()
    gap = knn.apart(low, high, low, high)
    least = [[((x[order][a : a + 256, None] - x[order][None, b : b + 256]) ** 2).sum(2).min() for b in range(0, 1000, 256)] for a in range(0, 1000, 256)]
    assert (gap <= np.array(least) + 1e-4).all()


def test_the_stop_passes_rows_over(tmp_path, spark):
    """Near pairs are all found although few of the other rows are verified."""
    r = np.random.default_rng(7)
    x = knn.unit(r.standard_normal((4096, 64)).astype(np.float32))
    x[1::2] = knn.unit(x[::2] + 0.02 * r.standard_normal((2048, 64)))
    proj = knn.projection(64)
    order = knn.leaf_order(x @ proj)
    x, ids = x[order], [f"i{i:04d}" for i in order]
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "part=0").mkdir()
    pq.write_table(pa.table({"ids": [ids], "vectors": [x.tobytes()], "ranks": [order.astype(np.int32).tobytes()]}), tmp_path / "part=0" / "a.parquet")
    p = x @ proj
    frame = (np.array([0]), p.min(0, keepdims=True), p.max(0, keepdims=True))
    own, _, best_s, best_i, known, verified = knn._neighbours(f"file:{tmp_path}", frame, 0, 0, 2048, 10, 64, 0.9, proj)
    s = x[:2048] @ x.T
    s[np.arange(2048), np.arange(2048)] = -1
    assert (best_s[:, 0] > 0.9).sum() >= 0.98 * (s.max(1) >= 0.9).sum()
    assert verified < 0.02 * 2048 * 4096


def test_knn_empty(spark):
    assert knn.all_neighbours(spark.createDataFrame([], "collection string, id string, embedding array<float>")).count() == 0


def test_chi2():
    assert abs(knn.chi2_quantile(0.95, 8) - 15.507) < 1e-2


def test_pack_respects_capacity():
    r = np.random.default_rng(1)
    sizes = np.minimum(512, r.geometric(1 / 120, 5000))
    box = pack.pack(sizes, 512)
    load = np.bincount(box, weights=sizes)
    assert load.max() <= 512 and sizes.sum() / (512 * (load > 0).sum()) > 0.97
    assert len(pack.pack(np.array([], dtype=int), 8)) == 0


def test_pack_frame(spark):
    df = spark.createDataFrame([(1, 5), (2, 0), (3, 25), (4, None), (5, 20), (None, 3)], "doc_id long, tokens int")
    out = pack.pack_documents(df, "doc_id", "tokens", {"p": 10}).collect()
    total = {}
    for r in out:
        total[r["doc_key"]] = total.get(r["doc_key"], 0) + r["tokens"]
    assert total == {"1": 5, "2": 0, "3": 25, "4": 0, "5": 20}
    load = {}
    for r in out:
        load[r["container"]] = load.get(r["container"], 0) + r["tokens"]
    assert max(load.values()) <= 10 and len({(r["container"], r["position"]) for r in out}) == len(out)
    assert sorted(r["first_token"] for r in out if r["doc_key"] == "3") == [0, 10, 20]


def test_shortage_goes_to_siblings_first():
    leaves = [("a", "en", 100), ("b", "en", 1000), ("c", "en", 5000)]
    got = mix.plan(leaves, {"a": (0.4, 1), "b": (0.1, 1), "c": (0.5, 1)}, 1000, {"a": "x", "b": "x", "c": "y"})
    assert got == {("a", "en"): 100, ("b", "en"): 400, ("c", "en"): 500}


def test_feasible_total_meets_every_share():
    leaves = [("a", "en", 100), ("b", "en", 1000), ("b", "fr", 500), ("c", "en", 5000)]
    targets = {"a": (0.2, 2), "b": (0.3, 1), "c": (0.4, 1), "none": (0.1, 3)}
    assert mix.feasible_total(leaves, targets) == 1000 and mix.feasible_total([], targets) == 0
    got = mix.plan(leaves, targets, None, {"a": "x", "b": "x", "c": "y"})
    used = {s: sum(v for (x, _), v in got.items() if x == s) for s in "abc"}
    assert sum(used.values()) == 1000 and used["a"] == 200 and used["b"] >= 300 and used["c"] >= 400


def test_language_lies_above_source():
    """A shortage goes to other sources of the same domain and language before other languages."""
    leaves = [("a", "en", 50), ("b", "en", 1000), ("b", "fr", 1000), ("c", "fr", 1000)]
    got = mix.plan(leaves, {"a": (0.4, 1), "b": (0.3, 1), "c": (0.3, 1)}, 1000, {"a": "x", "b": "x", "c": "x"})
    assert got[("a", "en")] == 50 and got[("b", "en")] == 500 and got[("b", "fr")] == 150 and got[("c", "fr")] == 300


def test_mix_frame(spark):
    docs = [(i, "a" if i % 3 else "b", ["en", "EN ", None, "fr"][i % 4], 10 + i % 7) for i in range(300)] + [(900, "unlisted", "en", 5), (901, "a", "en", 0), (902, None, "en", 5)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, lang string, tokens int")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    out, report = mix.mix(sized, targets, bucket_rows=20)
    used = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum("tokens_used").alias("n")).collect()}
    rep = {r["source"]: r for r in report.collect()}
    assert used["a"] == rep["a"]["used_tokens"] and used["b"] == rep["b"]["used_tokens"] and abs(rep["a"]["actual_share"] - 0.5) < 0.01
    assert rep["b"]["repeats"] <= 3 and rep["none"]["used_tokens"] == 0
    assert out.groupBy("doc_id", "epoch").count().where("count > 1").count() == 0 and out.where("doc_id >= 900").count() == 0


def test_tokens(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "a" * 20000)], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in tokens.with_tokens(df, ["doc_id"], "text", path).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1000
