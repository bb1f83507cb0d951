"""Files: sources, lists, artifacts, streams, and the pipeline from files to files."""

import os

import pytest
from pyspark.sql import functions as F

from concord import cli
from concord.operators.idf import document_frequency, smoothed_idf
from concord.operators.records import format_ids, keyed_records
from concord.plans import linkage
from concord.schema import PAIR_FEATURES, PAIR_IDS, BlockingConfig
from concord.sources import fixtures, tsv
from concord.streaming.ingest import stream_source, write_records

HEAD = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


def test_source_file(spark, tmp_path):
    path = tmp_path / "a.tsv"
    path.write_text("﻿" + HEAD + 'S1-1\tNA\t\tUS\nS1-2\t"Tab ""x"""\t1 St\t\n', encoding="utf-8")
    rows = {r.entity_id: r for r in tsv.read_source(spark, str(path)).collect()}
    assert (rows["S1-1"].business_name, rows["S1-1"].business_address, rows["S1-2"].country) == ("NA", "", "")
    assert rows["S1-2"].business_name == 'Tab "x"' and rows["S1-2"].business_address_normalized == "1 street"
    assert tsv.entity_ids(spark, str(path)).count() == 2


def test_ragged_and_incomplete_files(spark, tmp_path):
    (tmp_path / "short.tsv").write_text(HEAD + "S1-1\tx\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        tsv.read_source(spark, str(tmp_path / "short.tsv"), normalize=False).collect()
    (tmp_path / "less.tsv").write_text("entity_id\tcountry\nS1-1\tx\n")
    with pytest.raises(ValueError, match="missing columns"):
        tsv.read_source(spark, str(tmp_path / "less.tsv"))
    with pytest.raises(ValueError):
        tsv.source_path("x", "dev", "source1")


def test_lists_come_back(spark, tmp_path):
    path = str(tmp_path / "lists.tsv")
    lists = spark.createDataFrame([("S1-1", ["b", "a"]), ("S1-2", [])], "source1_entity_id string, candidate_entity_ids array<string>")
    tsv.write_lists(lists, path)
    assert open(path).read().splitlines()[0] == "source1_entity_id\tcandidate_entity_ids"
    assert {r[0]: r[1] for r in tsv.read_lists(spark, path).collect()} == {"S1-1": ["b", "a"], "S1-2": []}
    assert os.listdir(tmp_path) in (["lists.tsv"], [".lists.tsv.crc", "lists.tsv"], ["lists.tsv", ".lists.tsv.crc"])
    with pytest.raises(ValueError):
        tsv.write_lists(lists, path, [path])


def test_features_as_text(spark, tmp_path):
    path, values = str(tmp_path / "features.tsv"), [0.0, 1.0, 12.0, 1 / 3, 1.25e-7, 120000000.0]
    row = {f: values[i % len(values)] for i, f in enumerate(PAIR_FEATURES)}
    frame = spark.createDataFrame([("S1-1", "S2-1", "source2", *row.values())], ", ".join([*(f"{c} string" for c in PAIR_IDS), *(f"{c} double" for c in PAIR_FEATURES)]))
    tsv.write_features(frame, path)
    head, line = open(path).read().splitlines()
    assert head.split("\t") == [*PAIR_IDS, *PAIR_FEATURES] and line.split("\t")[3:9] == ["0", "1", "12", "0.33333333", "1.25e-07", "1.2e+08"]
    got = tsv.read_features(spark, path).first()
    assert all(abs(got[f] - x) <= 1e-8 * max(abs(x), 1) for f, x in row.items())
    with pytest.raises(ValueError):
        tsv.write_features(frame, path, [path])


def test_idf_artifact(spark, sf_dir, tmp_path):
    records = keyed_records(fixtures.entities(spark, sf_dir))
    idf = smoothed_idf(document_frequency(records), 50)
    tsv.save_idf(idf, str(tmp_path / "idf"), "train", 50, BlockingConfig())
    table, n = tsv.load_idf(spark, str(tmp_path / "idf"), BlockingConfig())
    assert n == 50 and table.count() == idf.count()
    with pytest.raises(ValueError):
        tsv.load_idf(spark, str(tmp_path / "idf"), BlockingConfig(n_features=1 << 10))


def test_stream_reads_each_file_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.tsv").write_text(HEAD + f"S1-{i}\tAcme Co\t\tUS\n")
    for _ in range(2):
        write_records(stream_source(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 3 and {r.business_name_normalized for r in rows} == {"acme company"}


@pytest.fixture(scope="module")
def root(spark, sf01_dir, tmp_path_factory):
    """Both splits hold the entities of sf0.01."""
    root = tmp_path_factory.mktemp("tsv")
    entities = fixtures.entities(spark, sf01_dir)
    for split in ("train", "test"):
        for s in ("source1", "source2", "source3"):
            tsv.write_tsv(entities.where(F.col("source_name") == s).drop("source_name"), tsv.source_path(str(root), split, s))
    truth = fixtures.ground_truth(spark, sf01_dir)
    tsv.write_tsv(truth.select("source1_entity_id", format_ids(F.col("matched_entity_ids")).alias("matched_entity_ids")), f"{root}/train/train_ground_truth.tsv")
    return str(root)


def test_from_files_to_files(spark, root, tmp_path_factory, capsys):
    out = str(tmp_path_factory.mktemp("out"))
    run = lambda *a: cli.main([a[0], "--data-root", root, *a[1:]])
    run("candidates", "--split", "train", "--output", f"{out}/train.tsv")
    run("features", "--split", "train", "--candidate-path", f"{out}/train.tsv", "--output", f"{out}/train.parquet", "--idf-path", f"{out}/idf")
    run("train", "--features", f"{out}/train.parquet", "--ground-truth", f"{root}/train/train_ground_truth.tsv", "--model", f"{out}/model", "--max-iter", "3")
    run("infer", "--candidates", f"{out}/test.tsv", "--features", f"{out}/test.parquet", "--model", f"{out}/model", "--idf", f"{out}/idf", "--output", f"{out}/matches.tsv")
    assert run("validate", "--matching", f"{out}/matches.tsv", "--candidate", f"{out}/test.tsv") == 0
    assert "PASS" in capsys.readouterr().out
    matches = tsv.read_truth(spark, f"{out}/matches.tsv")
    truth = {r[0]: set(r[1]) for r in tsv.read_truth(spark, f"{root}/train/train_ground_truth.tsv").collect()}
    found = {r[0]: set(r[1]) for r in matches.collect()}
    assert set(found) == set(truth)
    hits = sum(len(found[i] & truth[i]) for i in truth)
    assert hits >= 0.5 * sum(map(len, truth.values()))
    broken = f"{out}/broken.tsv"
    open(broken, "w").write("source1_entity_id\tmatched_entity_ids\nS1-0\tS2-0,S2-0\n")
    assert linkage.accept(spark, root, f"{out}/test.tsv", broken).count() > 1
    open(broken, "w").write("id\tmatched_entity_ids\n")
    assert [r.rule for r in linkage.accept(spark, root, f"{out}/test.tsv", broken).collect()] == ["header"]


def test_lists_keep_the_order_of_their_source(spark, tmp_path):
    from concord.sources import tsv

    ids = [f"S1-{(i * 37) % 101}" for i in range(101)]
    source, out = str(tmp_path / "s1.tsv"), str(tmp_path / "lists.tsv")
    with open(source, "w") as f:
        f.write("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join(f"{i}\tn\ta\tc\n" for i in ids))
    lists = spark.createDataFrame([(i, [f"S2-{i[3:]}"]) for i in sorted(ids)], "source1_entity_id string, candidate_entity_ids array<string>").repartition(7)
    for _ in range(2):  # the second replaces the first
        tsv.write_lists(lists, out, [source], tsv.file_order(spark, source))
    with open(out) as f:
        assert f.read() == "source1_entity_id\tcandidate_entity_ids\n" + "".join(f"{i}\tS2-{i[3:]}\n" for i in ids)
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["lists.tsv", "s1.tsv"]
    assert tsv.read_tsv(spark, source, ["entity_id"], multiline=False).count() == 101


def test_features_are_rounded_once(spark):
    from concord.plans.files import _through_file

    values = [0.0714284996, 0.9999995, 1 / 3, 0.1234564999, 0.0, 1.0]
    row = [values[i % len(values)] if "similarity" in f else 12345678 for i, f in enumerate(PAIR_FEATURES)]
    kinds = ["double" if "similarity" in f else "int" for f in PAIR_FEATURES]
    schema = ", ".join([*(f"{c} string" for c in PAIR_IDS), *(f"{f} {k}" for f, k in zip(PAIR_FEATURES, kinds, strict=True))])
    got = _through_file(spark, spark.createDataFrame([("S1-1", "S2-1", "source2", *row)], schema))
    assert [t for _, t in got.dtypes][3:] == kinds
    assert list(got.first())[3:] == [round(x, 6) for x in row]
