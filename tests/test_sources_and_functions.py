import json

import numpy as np
import pytest

from treeloom.functions import atlas, models, tensors
from treeloom.plans import pipeline
from treeloom.sources import lookups, node_files


@pytest.fixture
def files(tmp_path):
    texts = {
        "blank.swc": "# a comment\r\n##n type x y z r parent\r\n1 1 0 0 0 1 -1\r\n 2 2 1 0 0 1 1 \r\n# later\r\n3 2 2 0 0 1 2 9 9\r\n",
        "comma.swc": "1,1,0,0,0,1,-1\n2, 3, 1.5,0,0,1,1\n",
        "bad.swc": "1 1 0 0 0 1 -1\n2 2 x 0 0 1 1\n",
        "none.swc": "# nothing\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    return str(tmp_path)


def test_files(spark, files):
    nodes, rejects = node_files.read_node_files(spark, files, recursive=True)
    got = {r["tree_id"].rsplit("/", 1)[1]: r["count"] for r in nodes.groupBy("tree_id").count().collect()}
    assert got == {"blank.swc": 3, "comma.swc": 2}
    assert {(r["tree_id"].rsplit("/", 1)[1], r["reason"]) for r in rejects.collect()} == {("bad.swc", "parse_error"), ("none.swc", "empty")}
    assert all(r["first_parent_is_root"] for r in node_files.first_row_is_root(nodes).collect())


def test_files_keep_their_order(spark, tmp_path):
    for name in ("z.swc", "a.swc", "m.swc"):
        (tmp_path / name).write_text("1 1 0 0 0 1 -1\n2 2 1 0 0 1 1\n")
    nodes, _ = node_files.read_node_files(spark, [str(tmp_path / n) for n in ("z.swc", "a.swc", "m.swc")])
    assert [r["tree_id"].rsplit("/", 1)[1] for r in nodes.select("tree_id", "file_ord").distinct().orderBy("file_ord").collect()] == ["z.swc", "a.swc", "m.swc"]


def test_volumes(tmp_path):
    labels = np.zeros((2, 3, 4), np.int32)
    np.save(tmp_path / "v.npy", labels)
    np.savez(tmp_path / "v.npz", labels=labels, spacing=[10, 20, 30])
    assert lookups.load_volume(str(tmp_path / "v.npy")).spacing == (25.0, 25.0, 25.0)
    found = lookups.load_volume(str(tmp_path / "v.npz"))
    assert found.size == (2, 3, 4) and found.spacing == (10.0, 20.0, 30.0)


def test_weights_and_vectors(spark, tmp_path):
    w = {"enc/kernel": np.eye(2)}
    keep = lookups.BestWeights(str(tmp_path / "best.npz"))
    assert [keep(x, {"enc/kernel": np.eye(2) * x}) for x in (0.5, 0.4, 0.9)] == [True, False, True]
    assert np.allclose(lookups.load_weights(str(tmp_path / "best.npz"))["enc/kernel"], np.eye(2) * 0.9)
    lookups.REGISTRY["here"] = lambda: w
    assert lookups.pretrained("here") is w
    with pytest.raises(KeyError, match="nothing"):
        lookups.pretrained("nothing")
    (tmp_path / "v.txt").write_text("CTX 1 2\nunknow 0.5 -1\n")
    assert {r["token"]: r["vec"] for r in lookups.token_vectors(spark, str(tmp_path / "v.txt")).collect()} == {"CTX": [1.0, 2.0], "unknown": [0.5, -1.0]}
    (tmp_path / "names.csv").write_text("id,Abbreviation\n7,CTX\n")
    names = lookups.region_names(spark, str(tmp_path / "names.csv"), "id")
    ids = spark.createDataFrame([(1,), (2,)], "region_id bigint")
    rollup = spark.createDataFrame([(1, 7)], "region_id bigint, selected_id bigint")
    assert {r["region_id"]: r["abbreviation"] for r in atlas.id_to_abbreviation(ids, rollup, names).collect()} == {1: "CTX", 2: "unknown"}
    node_files.write_nodes(rollup, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_labels_and_evaluation(spark):
    table = spark.createDataFrame([("t", [[1.0]]), ("u", [[2.0]]), ("v", [[3.0]])], "tree_id string, values array<array<float>>")
    labels = spark.createDataFrame([("t", "b"), ("u", "a")], "tree_id string, label string")
    inputs, rejects = tensors.labelled(table, labels)
    assert {(r["tree_id"], r["label"], tuple(r["one_hot"])) for r in inputs.collect()} == {("t", "b", (0.0, 1.0)), ("u", "a", (1.0, 0.0))}
    assert [tuple(r) for r in rejects.collect()] == [("v", "no_label")]
    codes = spark.createDataFrame([(0,), (1,), (5,)], "code int")
    assert {r["code"]: r["label"] for r in tensors.decode_labels(codes, labels).collect()} == {0: "a", 1: "b", 5: None}
    scored = spark.createDataFrame([("t", [0.2, 0.8], "b"), ("u", [0.4, 0.6], "b")], "tree_id string, scores array<double>, label string")
    row = models.evaluate(scored, labels, ("a", "b")).first()
    assert (row["accuracy"], row["correct"], row["n"]) == (0.5, 1, 2) and row["loss"] == pytest.approx(-(np.log(0.8) + np.log(0.4)) / 2)
    seq = spark.createDataFrame([("t", "T"), ("t", "G"), ("u", "G")], "tree_id string, node_type string")
    assert [tuple(r) for r in tensors.without_terminal(seq).collect()] == [("u", "no_terminal")]


def test_stages_can_be_replaced_and_counted(spark):
    rows = [("a", 1, 1, 0.0, 0.0, 0.0, 1.0, -1)] + [("a", k, 2, float(20 * k), float(k % 2), 0.0, 1.0, k // 2) for k in range(2, 30)] + [("b", 1, 1, 0.0, 0.0, 0.0, 1.0, -1), ("b", 2, 2, 1.0, 0.0, 0.0, 1.0, 1), ("c", 1, 1, 0.0, None, 0.0, 1.0, -1)]
    nodes = spark.createDataFrame(rows, "tree_id string, n bigint, type int, x double, y double, z double, r double, parent bigint")
    whole = pipeline.TreeDataset(nodes)
    assert {(r["stage"], r["accepted"], r["rejected"]) for r in whole.counts().collect()} == {("quality_control", 1, 2), ("sequence", 1, 2)}
    assert {(r["tree_id"], r["reason"]) for r in pipeline.rejected(whole.cleaned()).collect()} == {("b", "unbranched"), ("c", "parse_error")}
    apart = pipeline.TreeDataset(read=lambda: nodes, qc=pipeline.quality_control, sequencer=pipeline.sequences)
    assert sorted(map(tuple, apart.sequence().collect())) == sorted(map(tuple, whole.sequence().collect()))


def test_trees_can_be_added_and_walked_otherwise(spark):
    rows = lambda name: spark.createDataFrame([(name, 1, 1, 0.0, 0.0, 0.0, 1.0, -1)] + [(name, k, 2, float(20 * k), float(k % 2), 0.0, 1.0, k // 2) for k in range(2, 30)], "tree_id string, n bigint, type int, x double, y double, z double, r double, parent bigint")
    both = pipeline.TreeDataset(rows("a")).add(rows("b"))
    ids = lambda data: {r["tree_id"] for r in data.sequence().select("tree_id").distinct().collect()}
    assert ids(both) == {"a", "b"} and ids(both.add(rows("c"), overwrite=True)) == {"c"}
    backwards = lambda tree, parts, ordering, lesser_first: [k for p in parts for k in p][::-1]
    assert pipeline.sequences(rows("a"), walk=backwards).orderBy("pos").first()["n"] == 23  # the last node of the part under 2, which comes second


def test_trees_over_many_batches(spark):
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(t, k, 2 if k > 1 else 1, float(k), float(t), 0.0, 1.0, k // 2 if k > 1 else -1) for t in range(5) for k in range(1, 20 + t)]
        nodes = spark.createDataFrame(rows, "tree_id bigint, n bigint, type int, x double, y double, z double, r double, parent bigint")
        found = pipeline.subtree_weights(nodes).where("n = 1").collect()
        assert {r["tree_id"]: r["size"] for r in found} == {t: 19 + t for t in range(5)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_further_columns(spark, tmp_path):
    (tmp_path / "a.swc").write_text("1 1 0 0 0 1 -1 0.5\n2 2 1 0 0 1 1 0.25\n")
    nodes, _ = node_files.read_node_files(spark, str(tmp_path / "a.swc"), ("level",))
    assert [r["level"] for r in nodes.orderBy("n").collect()] == [0.5, 0.25]


def test_atlas_rounds_half_to_even_and_knows_its_bounds(spark, tmp_path):
    volume = np.zeros((3, 3, 3), np.int64)
    volume[0, 0, 0], volume[2, 0, 0] = 5, 6
    (tmp_path / "r.json").write_text(json.dumps({"5": 50, "6": 60}))
    names = spark.createDataFrame([(50, "A"), (60, "B")], "selected_id bigint, abbreviation string")
    nodes = spark.createDataFrame([("t", 1, 12.5), ("t", 2, 37.5), ("t", 3, 62.5), ("t", 4, 90.0), ("t", 5, -30.0)], "tree_id string, n bigint, x double").selectExpr("*", "0d as y", "0d as z")
    out = atlas.annotate(nodes, lookups.volume_table(spark, volume), lookups.rollup_table(spark, str(tmp_path / "r.json")), names, (3, 3, 3), (25.0, 25.0, 25.0))
    assert [r["region"] for r in out.orderBy("n").collect()] == ["A", "B", "B", "unknown", "unknown"]


def test_tensors(spark):
    rows = [("t", k, 2, float(k), 0.0, 0.0, kind, region) for k, (kind, region) in enumerate([("B", "a"), ("T", "b"), ("G", "zz"), ("T", "fiber tracts"), ("G", "a")], 1)]
    seq = spark.createDataFrame(rows, "tree_id string, pos bigint, type int, x double, y double, z double, node_type string, region string")
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("fiber_tracts", [3.0]), ("unknown", [9.0])], "token string, vec array<double>")
    made = tensors.preprocess(seq, vectors)
    flat = tensors.flat_tensor(made, 7).first()["values"]
    assert [v[0] for v in flat] == [0, 0, 1, 2, 9, 3, 1]
    assert [v[0] for v in tensors.flat_tensor(made, 3).first()["values"]] == [9, 3, 1]
    nested = tensors.nested_tensor(made, 4, 3).first()["values"]
    assert [[s[0] for s in w] for w in nested] == [[0, 0, 0, 0], [0, 0, 1, 2], [0, 2, 9, 3]]
    with pytest.raises(ValueError, match="unknown"):
        tensors.preprocess(seq, vectors.where("token != 'unknown'"))
    labels = tensors.encode_labels(spark.createDataFrame([("t", "y"), ("u", "x")], "tree_id string, label string"))
    assert {(r["label"], r["code"], tuple(r["one_hot"])) for r in labels.collect()} == {("y", 1, (0.0, 1.0)), ("x", 0, (1.0, 0.0))}


def test_models(spark):
    w = models.random_gru(1, 4, "enc1", 1) | models.random_gru(4, 3, "enc2", 2) | models.random_gru(3, 2, "enc3", 3)
    x = np.zeros((1, 5, 1))
    x[0, 3:, 0] = [1, 2]
    assert np.allclose(models.encode(x, w), models.encode(x[:, 3:], w))  # steps of zeros are skipped
    pooled, share = models.attention(x, np.eye(1), np.zeros(1))
    assert np.allclose(share.sum(axis=1), 1) and pooled.shape == (1, 1)
    table = spark.createDataFrame([("t", x[0].tolist())], "tree_id string, values array<array<float>>")
    assert np.allclose(models.predict_latent(table, w).first()["latent"], models.encode(x, w)[0])
    rng = np.random.default_rng(0)
    c = models.random_gru(1, 4, "word", 4) | models.random_gru(4, 4, "sentence", 5) | {"dense/kernel": rng.normal(size=(4, 4)), "dense/bias": np.zeros(4), "out/kernel": rng.normal(size=(4, 3)), "out/bias": np.zeros(3)}
    assert np.allclose(models.classify(rng.normal(size=(2, 3, 4, 1)), c).sum(axis=1), 1)


def test_dataset_rejects_and_writes(spark, tmp_path):
    rows = [("a", 1, 1, 0.0, 0.0, 0.0, 1.0, -1)] + [("a", k, 2, float(20 * k), float(k % 2), 0.0, 1.0, k // 2) for k in range(2, 30)] + [("b", 1, 1, 0.0, 0.0, 0.0, 1.0, -1), ("b", 2, 2, 1.0, 0.0, 0.0, 1.0, 1)]
    nodes = spark.createDataFrame(rows, "tree_id string, n bigint, type int, x double, y double, z double, r double, parent bigint")
    assert [tuple(r) for r in pipeline.rejected(pipeline.quality_control(nodes)).collect()] == [("b", "unbranched")]
    pipeline.TreeDataset(nodes).write(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).select("tree_id").distinct().count() == 1


def test_training_stand_ins(spark):
    rows = [(f"t{k}", [[float(k % 2), 1.0]] * 3) for k in range(20)]
    table = spark.createDataFrame(rows, "tree_id string, values array<array<float>>")
    labels = spark.createDataFrame([(f"t{k}", "ab"[k % 2]) for k in range(20)], "tree_id string, label string")
    model, history = models.train_classifier(table, labels, 10)
    assert history.count() > 1 and model.summary.accuracy == 1.0
    assert models.train_encoder(table, 1).transform(models.mean_pooled(table)).count() == 20
    a, b = models.split(table)
    assert a.count() + b.count() == 20


def test_stream(spark, tmp_path):
    from treeloom.streaming import arrivals

    rows = [("a", k, 2 if k > 1 else 1, float(20 * k), float(k % 2), 0.0, 1.0, k // 2 if k > 1 else -1) for k in range(1, 30)]
    nodes = spark.createDataFrame(rows, "tree_id string, n bigint, type int, x double, y double, z double, r double, parent bigint")
    nodes.write.parquet(str(tmp_path / "in"))
    arrivals.sequence_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), nodes.schema, str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() > 10
