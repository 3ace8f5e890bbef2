"""What the plans of the trace queries must not do: move made-up nested records, look the same sources up again and again."""

from quillspan import queries_traces

SF = "/root/testdata/sf0.001"


def _plan(df) -> list[str]:
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)


def test_only_read_columns_are_collected(spark):
    collected = [line for line in _plan(queries_traces.loss_stages(spark, SF)) if "collect_list(" in line]
    assert collected and not any("searches" in line.split("collect_list(", 1)[1].split("collect_list_")[0].split(", 0, 0)")[0] for line in collected)


def test_a_materialisation_is_looked_up_once(spark):
    fold = next(line for line in _plan(queries_traces.development_examples(spark, SF)) if "aggregate(" in line)
    assert 0 < fold.count("map_keys(known") <= 2  # candidates and rows; the fold that nested them asked again for each use
