"""Counts of a stream are those of the same files read at once."""

from fourfold.operators.pileup import base_counts
from fourfold.sources import pileup
from fourfold.streaming.pileup import arriving_bases, keep_counts


def test_counts_follow_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("1 0 5 30 A\n1 1 6 -1 -\n1 2 7 20 C\n2 0 5 31 A\n")
    for more in (None, "3 0 5 12 G\n3 1 -1 30 T\n"):
        if more:
            (folder / "b.txt").write_text(more)
        query = keep_counts(arriving_bases(spark, str(folder)), "counts", str(tmp_path / "state"))
        assert query.awaitTermination(120)
        want = base_counts(pileup.bases(pileup.read_pileup(spark, str(folder)))).select("region", "ref_pos", "nuc", "n", "sum_qua")
        got = spark.table("counts").select("region", "ref_pos", "nuc", "n", "sum_qua")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
