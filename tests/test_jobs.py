import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from __spark_entry__ import queries

from flowspark.functions import ordering, stats
from flowspark import fixtures, session
from flowspark import schema as S
from flowspark.operators import detect, evaluate, models, quality
from flowspark.operators.models import TreeSettings
from flowspark.plans import dataset, prediction, training
from flowspark.sources import discovery, tables
from flowspark.sources.models import Detector, ModelRegistry, latest_model, register_model, training_runs
from flowspark.streaming import scoring

QUICK = TreeSettings(trees=4, depth=4)


@pytest.fixture(scope="module")
def trained(spark, sf_dir):
    return training.train_detector(fixtures.flows(spark, sf_dir), "flow_id", settings=QUICK)


# --- sources ----------------------------------------------------------------------------


def test_formats(spark, tmp_path):
    assert [tables.detect_format(p) for p in ("a.parquet", "b.CSV", "c.json", "d.dat", "e/")] == ["parquet", "csv", "json", "csv", "csv"]
    (tmp_path / "array.json").write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": None}]))
    assert {tuple(r) for r in tables.load_table(spark, str(tmp_path / "array.json")).collect()} == {(1, "x"), (2, None)}
    (tmp_path / "odd.dat").write_text("a,b\n1,x\n")
    assert tables.load_table(spark, str(tmp_path / "odd.dat")).collect() == [(1, "x")]
    with pytest.raises(ValueError):
        tables.load_table(spark, "x", "excel")
    with pytest.raises(ValueError):
        tables.save_table(spark.range(1), str(tmp_path / "p"), "pickle")


def test_directory(spark, tmp_path):
    for i in range(2):
        spark.range(3).coalesce(1).write.parquet(str(tmp_path / f"t{i}"))
    for i in range(2):
        part = next((tmp_path / f"t{i}").glob("*.parquet"))
        (tmp_path / f"flows_{i}.parquet").write_bytes(part.read_bytes())
    assert tables.load_directory(spark, str(tmp_path), "flows_*.parquet").count() == 6
    (tmp_path / "flows_9.parquet").write_bytes(b"broken")
    schema = spark.range(1).schema
    assert tables.load_directory(spark, str(tmp_path), "flows_*.parquet", schema).count() == 6
    with pytest.raises(ValueError):
        tables.load_directory(spark, str(tmp_path), "none_*.parquet")


def test_files_that_differ(spark, tmp_path):
    """Headers in another order, columns of one file only, int against double, broken files first and last, odd names."""
    (tmp_path / "a b+c.csv").write_text("x,y\n1,p\n")
    (tmp_path / "f1.csv").write_text("z,x\n0.5,2.5\n")
    got = tables.read_directory(spark, str(tmp_path), "*.csv")
    assert sorted(map(tuple, got.rows.select("x", "y", "z", tables.FILE_COLUMN).collect())) == [
        (1.0, "p", None, "a b+c.csv"), (2.5, None, 0.5, "f1.csv"),
    ]
    for name, rows, schema in (("m1", [(1, 2)], "a bigint, b int"), ("m2", [(3, 4.5)], "b int, a double")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
        part = next((tmp_path / name).glob("*.parquet"))
        (tmp_path / f"{name}.parquet").write_bytes(part.read_bytes())
    for name in ("a0.parquet", "z9.parquet"):
        (tmp_path / name).write_bytes(b"broken")
    (tmp_path / "only").mkdir()
    for part in tmp_path.glob("m?"):
        part.rename(tmp_path / "only" / part.name)
    found = tables.read_directory(spark, str(tmp_path), "*.parquet")
    assert sorted(map(tuple, found.rows.select("a", "b").collect())) == [(1.0, 2), (4.5, 3)]
    assert [p.rsplit("/", 1)[-1] for p, _ in found.skipped] == ["a0.parquet", "z9.parquet"] and all(r for _, r in found.skipped)


@pytest.mark.parametrize("by_task", [True, False])
def test_codes_and_damage_of_csv_files(spark, tmp_path, monkeypatch, by_task):
    """Text stays as it was written; tasks and Spark's own reader group the files alike."""
    import gzip

    monkeypatch.setattr(discovery, "reachable", lambda path: by_task)
    (tmp_path / "a.csv").write_text("zip,n,when,big,ok,x\n00123,7,2024-01-02,12345678901234567890,true,1\n,-8,,1,FALSE,.5\n")
    (tmp_path / "b.csv").write_text('x,zip,n,"a, b"\n-2e3,99,3000000000,"q ""z"""\nNaN,7, ,\n')
    (tmp_path / "c.csv.gz").write_bytes(gzip.compress(b"zip,n,when,big,ok,x\n+4,7,2024-01-02 03:04:05,2,true,Infinity\n"))
    (tmp_path / "d.csv.gz").write_bytes(b"no gzip at all")
    (tmp_path / "e.csv").write_text("")  # no bytes, no rows: passed over
    found = tables.read_directory(spark, str(tmp_path), "*.csv*", fmt="csv")
    types = dict(found.rows.dtypes)
    assert types["zip"] == types["n"] == types["big"] == types["a, b"] == "string"  # a blank is no number
    assert types["when"] == "timestamp" and types["ok"] == "boolean" and types["x"] == "double"
    rows = found.rows.select("zip", "n", "big", "ok", "x", tables.FILE_COLUMN).collect()
    assert {r["zip"] for r in rows} == {"00123", None, "99", "7", "+4"}
    assert {r["big"] for r in rows} == {"12345678901234567890", "1", "2", None}
    assert {str(r["x"]) for r in rows} == {"1.0", "0.5", "-2000.0", "nan", "inf"}
    assert [p.rsplit("/", 1)[-1] for p, _ in found.skipped] == ["d.csv.gz"] and found.skipped[0][1]
    given = T.StructType.fromDDL("zip string, n bigint, missing double")
    typed = tables.read_directory(spark, str(tmp_path), "[abc].csv*", given).rows
    assert sorted((r["zip"] or "", r["n"] or 0, r["missing"]) for r in typed.collect()) == [
        ("", -8, None), ("+4", 7, None), ("00123", 7, None), ("7", 0, None), ("99", 3000000000, None),
    ]


def test_values_of_one_csv_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c,d,e\n1,1,007,2024-02-30,\n2,3000000000,8,2024-01-01,\n")
    got = tables.load_table(spark, str(tmp_path / "t.csv"))
    assert got.dtypes == [("a", "int"), ("b", "bigint"), ("c", "string"), ("d", "string"), ("e", "string")]
    assert sorted(map(tuple, got.collect())) == [(1, 1, "007", "2024-02-30", None), (2, 3000000000, "8", "2024-01-01", None)]


def test_kinds_come_from_tasks(spark, tmp_path, monkeypatch):
    """Spark reads one schema per kind of file, not per file."""
    asked = []
    real = tables._file_schema
    monkeypatch.setattr(tables, "_file_schema", lambda *a: asked.append(a) or real(*a))
    monkeypatch.setattr(discovery, "FILES_PER_TASK", 2)
    for i in range(7):
        (tmp_path / f"f{i}.csv").write_text(f"k,v{i % 2}\n{i},{i}\n")
    assert tables.load_directory(spark, str(tmp_path), "*.csv").count() == 7
    groups, skipped = discovery.alike(spark, "csv", tables.list_files(spark, str(tmp_path), "*.csv"), None)
    assert [len(g) for g in groups] == [4, 3] and not skipped and not asked


def test_decimal_quantiles_on_both_paths(spark):
    df = spark.range(101).selectExpr("cast(id / 10 as decimal(10,2)) as d")
    small = stats.quantiles(df, {"d": [0.25, 0.505]})
    assert small == stats.quantiles(df, {"d": [0.25, 0.505]}, one_aggregate_cells=0, leaf_rows=5)


def test_repeated_keys_at_a_cut_on_both_paths(spark):
    df = spark.createDataFrame([(1, "a")] * 20, "k int, s string")
    for limit in (10, 0):
        with pytest.raises(Exception, match="does not identify a row"):
            ordering.with_part(df, ["s"], "k", 1, [lambda n: n * 0 + 4], max_strata=limit).collect()


def test_labelled_files(spark, tmp_path):
    for name in ("benign", "spoof_a", "strange"):
        spark.range(2).coalesce(1).write.parquet(str(tmp_path / "parts" / name))
        part = next((tmp_path / "parts" / name).glob("*.parquet"))
        (tmp_path / f"{name}.parquet").write_bytes(part.read_bytes())
    got = tables.load_labelled(spark, str(tmp_path))
    assert {tuple(r) for r in got.select("file_name", S.TARGET, "Label").distinct().collect()} == {
        ("benign.parquet", "normal", 0), ("spoof_a.parquet", "spoofing", 1), ("strange.parquet", "normal", 0),
    }
    assert tables.load_labelled(spark, str(tmp_path), unmatched="skip").count() == 4


def test_union_of_nothing():
    with pytest.raises(ValueError):
        tables.union_by_name([])


def test_shared_folder(spark):
    first, second = session.work_path(spark, "x"), session.work_path(spark, "x")
    assert first != second and first.startswith(session.shared_dir(spark))


# --- datasets --------------------------------------------------------------------------------


def test_captures_to_balanced_datasets(spark, sf_dir, tmp_path):
    raw = fixtures.raw_flows(spark, sf_dir).drop("label")
    for name, part in (("benign", 0), ("brute", 1), ("spoof", 2)):
        raw.filter(F.col("flow_id") % 3 == part).coalesce(1).write.parquet(str(tmp_path / "raw" / name))
        file = next((tmp_path / "raw" / name).glob("*.parquet"))
        (tmp_path / f"{name}.parquet").write_bytes(file.read_bytes())
    caps = {"normal": 300, "spoofing": 100}
    rows = dataset.assemble_captures(spark, str(tmp_path), "flow_id", caps=caps, default_cap=80)
    assert {r[0]: r[1] for r in rows.groupBy(S.TARGET).agg(F.count("*")).collect()} == {"normal": 300, "spoofing": 100, "brute_force": 80}
    written = dataset.build_dataset(rows, "flow_id", str(tmp_path / "set"))
    sizes = {tuple(r[:2]): r[2] for r in written.groupBy("split", S.TARGET).agg(F.count("*")).collect()}
    assert sizes["test", "normal"] == 60 and sizes["train", "brute_force"] == 64
    assert not [c for c in written.columns if c in S.IDENTIFIER_COLUMNS]
    assert spark.read.json(str(tmp_path / "set" / "statistics")).count() == 6
    outcome = dataset.balance_dataset(written, "flow_id", str(tmp_path / "balanced"), ("smote", "undersample", "other"))
    assert outcome["smote"] == outcome["undersample"] == "written" and outcome["other"].startswith("failed")
    grown = spark.read.parquet(str(tmp_path / "balanced" / "smote" / "data"))
    sizes = {tuple(r[:2]): r[2] for r in grown.groupBy("split", S.TARGET).agg(F.count("*")).collect()}
    assert {n for (s, _), n in sizes.items() if s == "train"} == {240} and sizes["test", "normal"] == 60
    under = spark.read.parquet(str(tmp_path / "balanced" / "undersample" / "data"))
    registry, runs = str(tmp_path / "registry"), str(tmp_path / "runs")
    sets = {"smote": grown, "undersample": under, "empty": under.limit(0)}
    winners, trained = training.compare_strategies(sets, "flow_id", runs, settings=QUICK, registry=registry)
    assert trained["smote"] == trained["undersample"] == "trained" and trained["empty"].startswith("failed")
    assert {r["metric"] for r in winners.collect()} == {"accuracy", "precision", "recall", "f1"}
    kept = ModelRegistry(spark, registry)
    assert {(r["name"], r["version"]) for r in kept.versions().collect()} == {("smote", 1), ("undersample", 1)}
    best = winners.filter("metric = 'f1'").first()["best_strategy"]
    assert kept.best("f1_macro")[0] == best
    tested = kept.load(best).score(grown.filter("split = 'test'"))
    assert tested.filter("label IS NOT NULL").count() == grown.filter("split = 'test'").count()
    for run in training_runs(spark, runs).collect():
        assert run["model"] == kept.path(run["strategy"]) and 0 <= run["train_f1"] <= 1
        assert set(run["importance"]) == set(Detector.load(spark, run["model"]).stage_two.features)
    with pytest.raises(ValueError, match="no strategy"):
        training.compare_strategies({"empty": under.limit(0)}, "flow_id", runs, settings=QUICK)


# --- models ------------------------------------------------------------------------------------


def test_training(trained, spark):
    assert trained.detector.stage_two.classes == S.CLASSES
    assert sum(trained.rows.values()) == 1500
    assert 0 < trained.test["accuracy"] <= 1 and set(trained.validation) == set(trained.test)
    importance = trained.importance.collect()
    assert len(importance) == len(trained.detector.stage_two.features) == 25
    scores = [r["importance"] for r in importance]
    assert scores == sorted(scores, reverse=True) and min(scores) == 0.0 < max(scores)
    gain = models.feature_importance(trained.detector.stage_two, spark, "gain")
    assert gain.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    assert models.top_features(gain, 3).count() == 3
    with pytest.raises(ValueError):
        models.feature_importance(trained.detector.stage_two, spark, "cover")


def test_training_evaluates_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def noted(i):
        seen.add(1)
        return float(i % 9)

    rows = spark.range(200).select(
        F.col("id").alias("flow_id"),
        noted(F.col("id")).alias("flow_duration"),
        F.when(F.col("id") % 9 < 4, "normal").otherwise("spoofing").alias(S.TARGET),
    )
    found = training.train_detector(rows, "flow_id", settings=TreeSettings(trees=2, depth=2))
    assert sum(found.rows.values()) == 200 and found.test["accuracy"] == 1.0
    assert seen.value == 200


def test_stages_share_prepared_vectors(spark):
    df = spark.range(300).select(
        (F.col("id") % 10).cast("double").alias("x"),
        (F.col("id") % 3).cast("double").alias("w"),
        F.when(F.col("id") % 10 < 3, S.NORMAL).when(F.col("id") % 10 < 7, "b").when(F.col("id") % 10 < 9, "c").alias(S.TARGET),
    )
    vectors = models.training_columns(df, ["x"], weight="w")
    assert vectors.columns == [models.VECTOR, S.TARGET, "w"] and vectors.count() == 270
    for train in (models.train_stage_one, models.train_stage_two):
        one, two = (train(rows, ["x"], settings=QUICK, weight="w").model.stages[-1].toDebugString for rows in (df, vectors))
        assert one.split("\n")[1:] == two.split("\n")[1:]
    with pytest.raises(ValueError, match="missing"):
        models.training_columns(vectors, ["x"], weight="absent")


def test_saved_detector_scores_alike(trained, spark, sf_dir, tmp_path):
    path = str(tmp_path / "model")
    trained.detector.save(spark, path)
    loaded = Detector.load(spark, path)
    flows = fixtures.flows(spark, sf_dir)
    one, two = (d.score(flows).select("flow_id", "label", "confidence") for d in (trained.detector, loaded))
    assert one.exceptAll(two).count() == 0
    info = loaded.info(spark).first()
    assert info["feature_count"] == 25 and info["classes"] == S.CLASSES and info["stage_one_loaded"]


def test_registry(spark, tmp_path):
    registry = str(tmp_path / "registry")
    for day, path in ((2, "new"), (1, "old")):
        register_model(spark, registry, "forest", path, datetime(2025, 1, day))
    register_model(spark, registry, "other", "x", datetime(2025, 2, 1))
    assert latest_model(spark, registry, "forest") == "new"
    assert latest_model(spark, registry, "missing") is None


def test_versions(spark, trained, tmp_path, monkeypatch):
    """A save that breaks off, before or while it commits, is never found; a repeated one is a version of its own."""
    kept = ModelRegistry(spark, str(tmp_path / "kept"))
    assert kept.versions().count() == 0 and kept.path("forest") is None and kept.best("f1") is None
    with pytest.raises(ValueError):
        kept.load("forest")
    first = kept.save("forest", trained.detector, {"classes": trained.report}, {"f1": 0.5})
    for broken in ("store", "commit"):
        with monkeypatch.context() as patch:
            target = Detector if broken == "store" else ModelRegistry
            name = "save" if broken == "store" else "commit"
            patch.setattr(target, name, lambda *a, **b: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError):
                kept.save("forest", trained.detector, metrics={"f1": 0.9})
        assert kept.path("forest") == first and kept.best("f1") == ("forest", first)
    second = kept.save("forest", trained.detector, metrics={"f1": 0.4})
    assert kept.path("forest") == second and kept.path("forest", 1) == first and kept.path("forest", 3) is None
    assert kept.best("f1") == ("forest", second)  # the newest of a name counts
    assert kept.load("forest", 1).stage_two.classes == trained.detector.stage_two.classes
    assert spark.read.json(f"{first}/reports/classes").count() == trained.report.count()


def test_training_on_a_given_split(spark, trained):
    rows = spark.range(400).select(
        "id", (F.col("id") % 7).cast("double").alias("x"), F.rand(3).alias("noise"),
        F.when(F.col("id") % 7 < 3, "low").otherwise("high").alias(S.TARGET),
        F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"),
    )
    found = training.train_on_split(rows, ["x", "noise"], settings=QUICK, with_stage_one=False)
    assert found.rows == {"train": 320, "test": 80} and set(found.metrics) == {"train", "test"} and found.validation == {}
    assert found.test["accuracy"] == 1.0 and found.importance.first()["feature"] == "x"
    assert {tuple(r) for r in found.confusion.collect()} == {("low", "low", 34), ("high", "high", 46)}
    with pytest.raises(ValueError, match="training"):
        training.train_on_split(rows.filter("split = 'test'"), ["x"], settings=QUICK)
    assert set(trained.metrics) == {"train", "validation", "test"}


def test_positions(spark, tmp_path):
    for name, parts, rows in (("a", 4, 50), ("b", 7, 45)):
        frame = spark.range(rows).select((F.col("id") * 3).alias("n" if name == "a" else "m"))
        frame.repartitionByRange(parts, frame.columns[0]).sortWithinPartitions(frame.columns[0]).write.parquet(str(tmp_path / name))
    a, b = (tables.load_with_position(spark, str(tmp_path / n)) for n in "ab")
    assert [r["n"] for r in a.orderBy("position").collect()] == [3 * i for i in range(50)]
    assert sorted(r["position"] for r in b.collect()) == list(range(45))
    met = evaluate.align_by_position(a, b).orderBy("position").collect()
    assert [(r["n"], r["m"]) for r in met] == [(3 * i, 3 * i if i < 45 else None) for i in range(50)]


def test_quarantine_beside_the_scored_rows(spark, sf_dir, tmp_path):
    flows = fixtures.flows(spark, sf_dir)
    flows.write.parquet(str(tmp_path / "in"))
    out, aside = str(tmp_path / "out"), str(tmp_path / "aside")
    for state in ("one", "two"):  # the second run knows nothing of the first
        stream = scoring.read_flow_stream(spark, str(tmp_path / "in"), flows.schema, files_per_trigger=3)
        scoring.score_and_quarantine(stream, lambda d: d.withColumn("label", F.lit("x")), out, aside, str(tmp_path / state)).awaitTermination()
    valid, broken = quality.split_by_contract(flows)
    assert spark.read.parquet(out).count() == valid.count() > 0
    got = spark.read.parquet(aside).select("flow_id", "reasons")
    assert got.exceptAll(broken.select("flow_id", "reasons")).count() == 0 and got.count() == broken.count() > 0


def test_text_ports_are_judged(spark):
    rows = [(1, "80", 5), (2, "99999", 5), (3, "http", 70000), (4, None, 5), (5, "-1", 5)]
    df = spark.createDataFrame(rows, "flow_id bigint, src_port string, dst_port int")
    found = {(r["rule"], r["column_name"]): r["violations"] for r in quality.flow_violations(df, ()).collect()}
    assert found["invalid_port", "src_port"] == 3 and found["invalid_port", "dst_port"] == 1
    reasons = {r["flow_id"]: r["reasons"] for r in df.select("flow_id", quality.contract_reasons(df).alias("reasons")).collect()}
    assert [i for i in reasons if "range:src_port" in reasons[i]] == [2, 3, 5] and "range:dst_port" in reasons[3]


def test_summary_is_taken_while_writing(spark, tmp_path):
    """The rows are evaluated once, and the summary equals that of the written ones."""
    calls = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    df = spark.range(100).selectExpr("id", "if(id % 4 = 0, 'normal', 'spoofing') label", "id / 100 confidence", "0 prediction")
    df = df.mapInArrow(count, "id bigint, label string, confidence double, prediction int")
    summary = tables.save_predictions(df, str(tmp_path / "p"))
    assert calls.value == 100
    written = spark.read.parquet(str(tmp_path / "p"))
    assert summary.collect() == detect.detection_summary(written, "predicted_label").collect()


def test_jobs(spark, sf_dir, tmp_path):
    data, model, runs = (str(tmp_path / n) for n in ("flows.parquet", "model", "runs"))
    fixtures.flows(spark, sf_dir).write.parquet(data)
    training.training_job(spark, data, "flow_id", model, None, runs, settings=QUICK, weighted=True, with_stage_one=False)
    run = training_runs(spark, runs).first()
    assert (run["train_rows"], run["validation_rows"], run["test_rows"]) == (1051, 225, 224)
    assert spark.read.json(f"{model}/reports/classes").count() >= 5
    detector = Detector.load(spark, model)
    strict = prediction.prediction_job(spark, detector, data, str(tmp_path / "out"), threshold=1.0).first()
    assert strict["total_samples"] == 1500 and strict["needs_review"] > 0
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert {"predicted_label", "confidence", "detection_path", "src_ip"} <= set(stored.columns)
    report = prediction.evaluation_job(spark, detector, data, str(tmp_path / "evaluation"))
    assert {"macro avg", "weighted avg", "normal"} <= {r["label"] for r in report.collect()}
    assert "is_correct" in spark.read.parquet(str(tmp_path / "evaluation" / "rows")).columns


def test_boosted_probabilities(spark):
    df = spark.range(300).select(
        (F.col("id") % 10).cast("double").alias("x"),
        F.when(F.col("id") % 10 < 3, "a").when(F.col("id") % 10 < 7, "b").otherwise("c").alias(S.TARGET),
        F.lit(1.0).alias("w"),
        (F.col("id") % 4 == 0).alias("is_validation"),
    )
    stage = models.train_stage_two(df, ["x"], learner="boosted", settings=TreeSettings(trees=3, depth=3), weight="w")
    rows = stage.predict(df).collect()
    assert all(sum(r["probabilities"]) == pytest.approx(1.0) for r in rows)
    assert all(r["label"] == r[S.TARGET] for r in rows)
    early = TreeSettings(trees=20, depth=3, validation_column="is_validation", validation_tolerance=0.5)
    one = models.train_stage_one(df.withColumn(S.TARGET, F.when(F.col(S.TARGET) == "a", "normal").otherwise("x")), ["x"], settings=early)
    assert {r["stage1_prediction"] for r in one.score(df).collect()} == {0, 1}
    assert one.model.stages[-1].getNumTrees < 20


def test_boosted_classes_asks_for_all_rounds(spark, sf_dir, monkeypatch):
    """The query trains at the library's settings; here they are noted and a single shallow round is trained."""
    asked, train = [], models.train_stage_two

    def quick(rows, features, **options):
        asked.append(options.pop("settings", None) or TreeSettings())
        return train(rows, features, settings=TreeSettings(trees=1, depth=1), **options)

    monkeypatch.setattr(models, "train_stage_two", quick)
    rows = queries()["boosted_classes"](spark, sf_dir)
    assert rows.count() == fixtures.flows(spark, sf_dir).count()
    assert asked == [TreeSettings()] and (asked[0].trees, asked[0].depth) == (100, 6)


def test_learners_at_once(spark, monkeypatch):
    """Models of the classes are the same whether they are fitted one by one or at the same time."""
    rows = spark.range(400).select(
        (F.col("id") % 20).cast("double").alias("x"), F.element_at(F.array(*map(F.lit, "abcd")), (F.col("id") % 4 + 1).cast("int")).alias(S.TARGET)
    )
    found = []
    for most in (0, 10_000):
        monkeypatch.setattr(models, "ROWS_AT_ONCE", most)
        stage = models.train_stage_two(rows, ["x"], learner="boosted", settings=QUICK)
        found.append([m.toDebugString.split("\n", 1)[1] for m in stage.tree_models()])
    assert found[0] == found[1] and len(found[0]) == 4
    with pytest.raises(ZeroDivisionError):
        models.fit_at_once(spark, [lambda: 1, lambda: 1 // 0], 2)


def test_single_flow(spark, tmp_path):
    rows = spark.range(200).select(
        F.lit("10.0.0.1").alias("src_ip"),
        F.lit("TCP").alias("protocol"),
        F.col("id").cast("double").alias("flow_duration"),
        F.when(F.col("id") < 100, "normal").otherwise("spoofing").alias(S.TARGET),
        F.col("id").alias("flow_id"),
    )
    detector = training.train_detector(rows, "flow_id", settings=QUICK).detector
    low = prediction.predict_one(spark, detector, {"src_ip": "10.0.0.1", "protocol": "TCP", "flow_duration": 5.0})
    high = prediction.predict_one(spark, detector, {"src_ip": "10.0.0.1", "protocol": "TCP", "flow_duration": 190})
    assert (low["label"], high["label"]) == ("normal", "spoofing")
    assert sum(high["probabilities"]) == pytest.approx(1.0)


# --- streams -------------------------------------------------------------------------------------


def test_stream_equals_batch(trained, spark, sf_dir, tmp_path):
    flows = fixtures.flows(spark, sf_dir)
    source = str(tmp_path / "in")
    flows.repartition(4).write.parquet(source)
    stream = scoring.read_flow_stream(spark, source, flows.schema, files_per_trigger=1)
    output, place = str(tmp_path / "out"), str(tmp_path / "state")
    scoring.score_stream(stream, trained.detector.score, output, place).awaitTermination()
    columns = ["flow_id", "label", "confidence"]
    batch = trained.detector.score(flows).select(columns)
    assert spark.read.parquet(output).select(columns).exceptAll(batch).count() == 0
    assert spark.read.parquet(output).count() == 1500
    # a restart has nothing left to do
    scoring.score_stream(stream, trained.detector.score, output, place).awaitTermination()
    assert spark.read.parquet(output).count() == 1500
    summaries, second = str(tmp_path / "sums"), str(tmp_path / "state2")
    scoring.summarize_stream(stream, trained.detector.score, summaries, second).awaitTermination()
    assert spark.read.parquet(summaries).count() == 4
    assert scoring.total_summary(spark, summaries).first()["total_samples"] == 1500


def test_raw_scaled_detector(spark, sf_dir, tmp_path):
    raw = fixtures.raw_flows(spark, sf_dir).drop("Flow ID", "Src IP", "Dst IP")
    trained = training.train_detector(
        raw, "flow_id", settings=QUICK, raw=True, scaling="robust", with_stage_one=False, learner="boosted"
    )
    trained.detector.save(spark, str(tmp_path / "model"))
    loaded = Detector.load(spark, str(tmp_path / "model"))
    assert loaded.steps == trained.detector.steps and len(loaded.steps) == 2
    one, two = (d.score(raw.drop("label")).select("flow_id", "label", "confidence") for d in (trained.detector, loaded))
    assert one.exceptAll(two).count() == 0 and one.count() == 1500


def test_long_codes_are_saved_with_the_model(spark, tmp_path):
    df = spark.range(3000).select(
        F.col("id").alias("k"),
        F.concat(F.lit("app"), F.col("id") % 1500).alias("app"),
        F.when(F.col("id") % 1500 < 700, "normal").otherwise("spoofing").alias(S.TARGET),
    )
    trained = training.train_detector(df, "k", settings=QUICK, with_stage_one=False)
    path = str(tmp_path / "model")
    trained.detector.save(spark, path)
    loaded = Detector.load(spark, path)
    assert loaded.steps[0].codes.long["app"].startswith(path)
    assert loaded.prepare(df).select("app").distinct().count() == 1500


def test_predictions_that_are_small_on_disk_are_not_broadcast_to_meet_their_truth(spark, tmp_path):
    from flowspark.operators import evaluate
    from flowspark.sources import tables

    spark.range(2000).select("id", F.lit("normal").alias("true_label")).write.parquet(f"{tmp_path}/truth")
    spark.range(1990).select(F.lit("normal").alias("label")).write.parquet(f"{tmp_path}/found")
    aligned = evaluate.align_by_position(*[tables.load_with_position(spark, f"{tmp_path}/{n}") for n in ("truth", "found")])
    plan = aligned._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "LeftOuter, BuildRight" not in plan
    assert aligned.filter("label IS NULL").count() == 10
