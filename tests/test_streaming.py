import pytest

from cladeloom.streaming.trees import score_arriving_trees


def test_trees_are_scored_once_as_they_arrive(spark, tmp_path):
    patterns = spark.createDataFrame([(0, "00", 2), (1, "01", 1)],
                                     "pattern_id bigint, pattern string, freq bigint")
    taxa = spark.createDataFrame([(0, "a"), (1, "b")], "taxon_id bigint, taxon string")
    inbox = tmp_path / "in"
    inbox.mkdir()
    want = 2 * -1.6703297115834077 - 3.8822216538287098

    def run():
        score_arriving_trees(spark, str(inbox), patterns, taxa, str(tmp_path / "out"),
                             str(tmp_path / "state")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).collect()

    (inbox / "1.nwk").write_text("(a:0.1,b:0.2);(b:0.2,a:0.1);")
    assert [r.loglik for r in run()] == pytest.approx([want, want])
    (inbox / "2.nwk").write_text("(a:0.15,b:0.15);\n")
    rows = run()
    assert len(rows) == 3 and all(r.loglik == pytest.approx(want) for r in rows)
