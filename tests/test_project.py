"""Projection by packed columns against a plain loop, and its plans: nothing that an explode made is sent to every task."""

import random

import pytest
from pyspark.sql import functions as F

from fourfold.functions import codec
from fourfold.operators import project
from fourfold.plans import q_align


def by_hand(target, line, pos, ops, seq, qual, reverse, columns):
    """What project() gives for one read: columns are (col, symbol, pos, base) along the target."""
    index, at, k = {}, pos, 0
    for op, n in ops:
        for _ in range(n):
            if op in "M=X":
                index[at] = k
            at, k = at + (op in "MDN=X"), k + (op in "MIS=X")
    held = [c for c, _, p, _ in columns if p is not None and pos <= p < at]
    out = []
    for c, symbol, p, base in columns:
        if held and held[0] <= c <= held[-1]:
            i = index.get(p)
            letter = None if i is None else seq[i].translate(str.maketrans("ACGT", "TGCA")) if reverse else seq[i]
            out.append((target, line, c, symbol, base, i, None if i is None else ord(qual[i]) - 33, letter))
    return out


def test_project_both_ways(spark):
    """Genomes that run forwards and backwards, gaps at bounds of stretches, reads over either end and outside."""
    draw = random.Random(5)
    pairs, reads, want = [], [], []
    for target, step in ((1, 1), (2, -1), (3, 1)):
        n = 4 * project.STRETCH
        seq_b = "--" + "".join(draw.choice("ACGT---") for _ in range(n)) + "-"
        pairs.append((target, "".join(draw.choice("ACGT") for _ in seq_b), seq_b, 1, 1000, step))
        places = iter(range(1000, 1000 + step * n, step))
        columns = [(c, "J" if x == "-" else "M", None if x == "-" else next(places), x) for c, x in enumerate(seq_b)]
        known = [p for _, _, p, _ in columns if p is not None]
        for line in range(40):
            ops = [("H", 3), ("S", 2), ("M", draw.randint(1, 90)), ("D", draw.randint(1, 70)), ("=", 4), ("I", 3), ("X", draw.randint(1, 9)), ("N", 2), ("M", 5)]
            length = sum(k for op, k in ops if op in "MIS=X")
            seq, qual = ("".join(draw.choice(x) for _ in range(length)) for x in ("ACGT", "+5I"))
            pos = draw.randint(min(known) - 120, max(known) + 20)
            reads.append((target, line, pos, "".join(f"{k}{op}" for op, k in ops), seq, qual, step < 0))
            want += by_hand(target, line, pos, ops, seq, qual, step < 0, columns)
    columns = project.universal_columns(spark.createDataFrame(pairs, "target long, seq_a string, seq_b string, first_a long, first_b long, step_b int"))
    columns = columns.select("target", "col", "symbol", F.col("pos_b").alias("pos"), F.col("base_b").alias("base"))
    rows = spark.createDataFrame(reads, "target long, line long, pos int, cigar string, seq string, qual string, back boolean").withColumn("ops", codec.parse_cigar(F.col("cigar")))
    got = project.project(rows, columns, F.col("back"))
    assert got.columns == ["target", "line", "col", "symbol", "ref_base", "read_idx", "qua", "nuc"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", ["alignment_scores", "projected_reads", "pileup_text_rows"])
def test_columns_are_not_sent_to_every_task(spark, sf_dir, name):
    """Columns are many times their sequences, which Spark goes by: they were broadcast, and too large for the driver at six times sf0.1."""
    plan = q_align.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
