"""Chat formatting, vector search and the pipeline."""

import numpy as np
import pytest

from graphloom.llm import chat, vafile


def test_prefix_targets(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", None), (1, 3, "assistant", "bye"), (1, 3, "assistant", "bye"), (2, 0, "assistant", ""), (None, 0, "assistant", "x"), (3, None, "assistant", "x"), (4, 0, None, "x"), (5, 0, "user", "only"), (6, 0, "user", "y " * 50_000), (6, 1, "assistant", "z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, turns int")
    got = {(x["conv_id"], x["turn"]): x for x in chat.prefix_targets(df).collect()}
    assert set(got) == {(1, 1), (1, 3), (2, 0), (6, 1)}
    x = got[1, 3]
    assert x["prompt"] == "<|user|>\nhi\n<|assistant|>\nhello\n<|user|>\n\n<|assistant|>\n" and x["n_context"] == 3
    assert (x["prompt"] + x["reply"])[x["loss_start"] : x["loss_end"]] == "bye"
    assert got[2, 0]["loss_start"] == got[2, 0]["loss_end"]
    assert chat.prefix_targets(df.limit(0)).count() == 0


@pytest.mark.parametrize("bits, most", [(2, 500_000), (5, 0)])
def test_vector_file_is_exact(spark, monkeypatch, bits, most):
    r = np.random.default_rng(1)
    x = r.normal(size=(150, 8)).astype(np.float32)
    x[100:110] = x[0]  # ties
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(None, x[0].tolist(), 0), (500, None, 0), (501, [1.0], 0), (502, [float("nan")] * 8, 0), (503, [None] * 8, 0), (7, x[7].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block int")
    monkeypatch.setattr(vafile.candidates, "__defaults__", (bits, 40, 60))
    monkeypatch.setattr(vafile, "MAX_BROADCAST", most)
    got = vafile.top_k(df, 5, bits=bits).toPandas().sort_values(["vec_id", "rank"])
    d = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(150), d.shape), d), axis=1)[:, :5]
    assert (got.neighbor_id.to_numpy().reshape(-1, 5) == order).all()
    assert np.allclose(got.distance.to_numpy().reshape(-1, 5), np.take_along_axis(d, order, 1), atol=1e-5)
    few = vafile.top_k(df, 5, queries=df.where("vec_id % 10 = 0"), bits=bits).toPandas().sort_values(["vec_id", "rank"])
    assert (few.neighbor_id.to_numpy().reshape(-1, 5) == order[::10]).all()


@pytest.mark.parametrize("size", [1e20, 1e-30, 3e38])
def test_vector_file_of_any_magnitude(spark, size):
    r = np.random.default_rng(2)
    x = (r.uniform(-1, 1, (90, 6)) * size).astype(np.float32)
    x[::9] /= np.float32(1e6)  # some of them all but equal beside the others
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = vafile.top_k(df, 4).toPandas().sort_values(["vec_id", "rank"])
    d = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert (got.neighbor_id.to_numpy().reshape(-1, 4) == np.argsort(d, axis=1, kind="stable")[:, :4]).all()


def test_vector_file_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert vafile.top_k(spark.createDataFrame([], schema)).count() == 0
    assert vafile.top_k(spark.createDataFrame([(1, [1.0, 2.0])], schema)).count() == 0
    assert vafile.top_k(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema), 3).count() == 2


def test_pipeline_keeps_and_drops(spark, tmp_path):
    import corpus_pipeline

    word = lambda i, n, k=37: " ".join(f"t{(i * k + j * j + 7 * j) % 997}" for j in range(n))
    clean = [(i, word(i, 60) + ". ") for i in range(40)]
    passage = word(990, 30, 11) + ". " + word(991, 30, 13) + ". " + word(993, 30, 17) + ". "
    docs = [*clean, (100, clean[3][1]), (101, passage + clean[5][1][:40]), (102, word(600, 50, 5) + ". " + passage), (103, "xx " + word(800, 40, 3) + " yy"), (None, word(700, 30, 19)), (104, None), (105, "")]
    docs = [(i, t, "en", "s", len(t or ""), 1) for i, t in docs]
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, tid int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, word(800, 40, 3))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    out = {x["doc_id"]: x for x in corpus_pipeline.run(spark, folder).collect()}
    assert set(out) == {*range(40), 101, 102, 104, 105, None}
    from graphloom.llm import bpe

    text = bpe.Codec(*bpe.split_table()).decode(np.array(out[102]["ids"])).decode()
    assert passage.strip() not in text and text.startswith("t")
    assert all(x["round_trip"] for x in out.values() if x["ids"] is not None)
