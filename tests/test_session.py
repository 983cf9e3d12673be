import pytest

from fieldsift import session
from fieldsift.operators import sampling
from fieldsift.operators.model import NoteClassifier


class FakeConf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class FakeSession:
    def __init__(self, **conf):
        self.conf = FakeConf({k.replace("_", "."): v for k, v in conf.items()})


def test_named_folder_is_used():
    spark = FakeSession(spark_checkpoint_dir="hdfs://x/dir/", spark_master="yarn")
    assert session.shared_root(spark) == "hdfs://x/dir"
    assert session.shared_path(spark, "a").startswith("hdfs://x/dir/fieldsift/a-")
    assert session.shared_path(spark, "a") != session.shared_path(spark, "a")


def test_cluster_needs_a_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_root(FakeSession(spark_master="spark://x:7077"))


def test_stage_keeps_rows_and_schema(spark):
    df = spark.range(5).selectExpr("id", "array(id) AS a", "cast(null AS string) AS s")
    staged = session.stage(df, "test")
    assert staged.schema.names == df.schema.names
    assert sorted(map(tuple, staged.collect())) == sorted(map(tuple, df.collect()))
    plan = staged._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan


def staged_names(root):
    return {p.name.rsplit("-", 1)[0] for p in (root / "fieldsift").glob("*")} if (root / "fieldsift").exists() else set()


@pytest.fixture
def root(spark, tmp_path, monkeypatch):
    """The shared folder of this test alone."""
    monkeypatch.setattr(session, "shared_root", lambda _: str(tmp_path))
    return tmp_path


def test_scratch_deletes_what_was_staged_within(spark, root):
    with session.scratch(spark):
        session.stage(spark.range(3), "outer")
        with session.scratch(spark):
            kept = session.stage(spark.range(4), "kept", keep=True)
            session.stage(spark.range(5), "inner")
            assert staged_names(root) == {"outer", "kept", "inner"}
        assert staged_names(root) == {"outer", "kept"}
    session.stage(spark.range(6), "free")
    assert staged_names(root) == {"kept", "free"} and kept.count() == 4


def test_after_an_error_the_scope_around_deletes(spark, root):
    with session.scratch(spark):
        with pytest.raises(ZeroDivisionError), session.scratch(spark):
            session.stage(spark.range(3), "inner")
            raise ZeroDivisionError
        assert staged_names(root) == {"inner"}
    assert staged_names(root) == set()


def test_a_split_leaves_no_tables(spark, root):
    notes = spark.range(300).selectExpr("id AS note_id", "concat('note ', id) AS input", "cast(id % 3 AS string) AS output")
    split = sampling.stratified_split(notes, sort_limit=10)
    folds = sampling.stratified_folds(notes, sort_limit=10)
    picks = sampling.fewshot_by_stride(notes, sort_limit=10)
    assert staged_names(root) == set()
    assert split.where("split = 'test'").count() == 60
    assert folds.groupBy("fold").count().count() == 5 and picks.count() == 18


def test_a_fit_leaves_no_tables(spark, root):
    notes = spark.range(60).selectExpr("id AS note_id", "concat('word', id % 2, ' and more') AS input", "cast(id % 2 AS string) AS output")
    model = NoteClassifier.fit(notes, n_trees=2, tree_depth=3)
    assert staged_names(root) == set()
    assert model.predict(notes).where("issue_category <> output").count() == 0
