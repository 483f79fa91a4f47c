from __future__ import annotations

import pytest

from builders import COLUMNS, SCHEMA, frame, training_rows
from fingerloom.functions import scalars as S
from fingerloom.session import shared_dir
from fingerloom.sources import tables as Tb
from pyspark.sql import functions as F
from pyspark.sql import types as T


def test_csv_contract(spark, tmp_path):
    schema = T._parse_datatype_string(SCHEMA)
    df = frame(spark, training_rows())
    Tb.write_sessions(df.withColumn("weakest_inferred", F.lit("x")), str(tmp_path / "s"), format="csv")
    back = Tb.read_sessions(spark, str(tmp_path / "s"), schema=schema)
    assert back.columns == COLUMNS and back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()
    Tb.write_sessions(df.limit(0), str(tmp_path / "e"), format="csv")
    with pytest.raises(ValueError, match="no rows"):
        Tb.read_sessions(spark, str(tmp_path / "e"), schema=schema)
    with pytest.raises(ValueError, match="No column"):
        Tb.read_sessions(spark, str(tmp_path / "s"), schema=schema, target="other")


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_scalars(spark):
    errors = {f: F.lit(v) for f, v in (("left_ring", 0.2), ("left_index", 0.2), ("right_ring", None))}
    assert one(spark, S.weakest_by_max_error(errors)) == "left_index"
    assert one(spark, S.weakest_by_column_order(errors)) == "left_ring"
    none = {f: F.lit(None).cast("double") for f in errors}
    assert one(spark, S.weakest_by_max_error(none)) == "left_index" and one(spark, S.weakest_by_column_order(none)) is None
    assert one(spark, S.model_key(F.lit("  a@@B! "))) == "a_b" and one(spark, S.model_key(F.lit("@@"))) == "anonymous"
    assert one(spark, S.filename_segment(F.lit(" a b#c@d.e "))) == "a_b_c@d.e" and one(spark, S.filename_segment(F.lit(" "))) == "unknown"
    assert one(spark, S.accuracy_to_unit_bounded(F.lit(150.0))) == 150.0 and one(spark, S.accuracy_to_unit(F.lit(150.0))) == 1.5
    assert one(spark, S.clip_round(F.lit(2.5), 0, 9)) == 2 and one(spark, S.clip_round(F.lit(3.5), 0, 9)) == 4
    assert one(spark, S.to_number(F.lit("nan"))) is None and one(spark, S.to_number(F.lit(" 1e3 "))) == 1000.0
    assert one(spark, S.lineage_folder(F.lit(" REAL "))) == "production"
    with pytest.raises(Exception, match="Unknown data type"):
        one(spark, S.lineage_folder(F.lit("fake")))
    assert one(spark, S.decode_label(F.lit(5), ["a", "b"])) == "5"
    with pytest.raises(Exception, match="outside"):
        one(spark, S.decode_label(F.lit(5), ["a", "b"], strict=True))
    p = one(spark, S.prediction_struct(F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2)), ["x", "y", "z"]))
    assert p["prediction"] == "x" and p["confidence"] == 40.0 and p["probabilities"]["z"] == 0.2


def test_a_repeated_commit_leaves_one_model(spark, tmp_path):
    """One token: one model and one row, whoever commits first; a half-written model is never listed."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer

    from fingerloom.sources import registry as R

    root, model = str(tmp_path / "models"), PipelineModel([SQLTransformer(statement="SELECT * FROM __THIS__")])
    save = lambda **k: R.save_model(spark, model, root, key="u-1", algorithm="x", features=["a"], classes=["p", "q"], **k)
    first, again, other = save(token="task/1"), save(token="task/1"), save(token="task/2")
    assert first == again != other
    assert R.read_registry(spark, root).count() == 2 and R.read_registry(spark, root, R.PERSONAL, "u-1").count() == 2
    assert R.read_registry(spark, root, R.PERSONAL, "u-2").count() == 0
    assert {r.model_path for r in R.stored_artifacts(spark, root).collect()} == {first, other}
    # Two writers past the first look: the one who commits second takes the other's model and leaves nothing.
    seen, R._read_commit = R._read_commit, lambda *a: None
    try:
        lost, system = [], R._put_if_absent
        R._put_if_absent = lambda s, path, text: (lost.append(path), setattr(R, "_read_commit", seen), system(s, path, text))[-1]
        assert save(token="task/1") == first
    finally:
        R._read_commit, R._put_if_absent = seen, system
    assert len(lost) == 1 and R.read_registry(spark, root).count() == 2
    assert {r.model_path for r in R.stored_artifacts(spark, root).collect()} == {first, other}
    # An artifact without a commit is not a model.
    model.write().save(f"{root}/production/personal/u-3-x")
    assert R.read_registry(spark, root, R.PERSONAL, "u-3").count() == 0


def test_two_promoters_leave_one_active_model(spark, tmp_path):
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer

    from fingerloom.operators.models import in_threads
    from fingerloom.sources import registry as R

    root, model = str(tmp_path / "models"), PipelineModel([SQLTransformer(statement="SELECT * FROM __THIS__")])
    paths = in_threads([lambda: R.save_model(spark, model, root, scope=R.GLOBAL, key=R.GLOBAL_KEY, algorithm="x", features=["a"], classes=["p"])] * 2)
    active = R.active_models(R.read_registry(spark, root), R.stored_artifacts(spark, root)).collect()
    assert len(set(paths)) == 2 and len(active) == 1 and R.load_model(spark, root)[1]["model_path"] == active[0]["model_path"]


def test_a_text_is_read_as_a_number_once(spark):
    texts = spark.createDataFrame([(" 1.5 ",), ("1e3",), ("nan",), ("NaN",), ("n/a",), ("",), (None,), ("-0",), ("inf",)], "t string")
    numbers = texts.select(S.to_number(F.col("t")).alias("n"))
    assert [r.n for r in numbers.collect()] == [1.5, 1000.0, None, None, None, None, None, 0.0, float("inf")]
    assert numbers._jdf.queryExecution().optimizedPlan().toString().count("cast(t#") == 1
    assert [r.n for r in spark.createDataFrame([(float("nan"),), (2.0,), (None,)], "t double").select(S.to_number(F.col("t")).alias("n")).collect()] == [None, 2.0, None]
