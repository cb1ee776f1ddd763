from random import Random

from assayer.operators.coverage import ORACLES, title_jaccard

from .oracle import duck, rows


def _parts(spark, tmp_path, names):
    made = [(n, name, f"Brand#{n % 3}", n % 2) for n, name in enumerate(names)]
    spark.createDataFrame(made, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def test_titles_of_every_length_meet_as_in_all_pairs(spark, tmp_path):
    draw = Random(3)
    at = _parts(spark, tmp_path, [" ".join(draw.choice("abcdefg") for _ in range(draw.randint(0, 7))) for _ in range(300)])
    spark_rows = rows(title_jaccard(spark, at).toPandas())
    assert spark_rows == rows(duck(ORACLES["title_jaccard"].replace("FROM part", f"FROM read_parquet('{at}/part.parquet/*.parquet')"), "/none"))
    assert len(spark_rows) > 100


def test_parts_without_a_word_in_common_never_meet(spark, tmp_path):
    """Both sides of the join of kinds have the word among its keys."""
    plan = title_jaccard(spark, _parts(spark, tmp_path, ["one two", "two one", "three"]))
    assert "word#" in plan._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count() == 0
