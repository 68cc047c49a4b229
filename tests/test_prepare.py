"""Preparation on small files with every kind of alignment, then sources and sinks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fourfold.functions import codec
from fourfold.plans import phase
from fourfold.plans.genotype import genotype
from fourfold.plans.options import Options
from fourfold.plans.prepare import prepare_alignment
from fourfold.sources import fastx, pileup, sam

#     col  0123456789
SEQ_A = "ACGT-ACGTA"
SEQ_B = "ACTTGAC-TA"
Q = "I"


def record(name, flag, rname, pos, cigar, seq, qual=None):
    return "\t".join([name, str(flag), rname, str(pos), "60", cigar, "*", "0", "0", seq, qual or Q * len(seq)])


@pytest.fixture
def files(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    refs = write("refs.fa", f">chrA:10-19\n{SEQ_A[:4]}\n{SEQ_A[4:]}\n>chrB:20-29\n{SEQ_B}\n")
    ref_sam = write("refs.sam", "@SQ\tSN:chrA:10-19\tLN:9\nchrB:20-29\t0\tchrA:10-19\t1\t255\t4M1I2M1D2M\t*\n*\n")
    a = [
        record("same", 0, "chrA", 11, "9M", "ACGTACGTA"),
        record("likeB", 0, "chrA", 11, "4M1I5M", "ACTTGACGTA"),
        record("clip", 0, "chrA", 13, "2S4M", "NNGTAC"),
        record("cut", 0, "chrA", 11, "3M2D4M", "ACGCGTA"),
        record("over", 0, "chrA", 8, "7M", "TTTACGT"),
        record("low", 0, "chrA", 11, "4M", "ACGT", "I#II"),
        record("onlyA", 0, "chrA", 11, "4M", "ACGT"),
        record("twice", 0, "chrA", 11, "4M", "ACGT"),
        record("twice", 0, "chrA", 12, "3M", "CGT"),
        record("other", 0, "chrC", 11, "4M", "ACGT"),
        record("lost", 4, "chrA", 11, "*", "ACGT"),
    ]
    b = [
        record("same", 0, "chrB", 21, "4M1D2M1I2M", "ACGTACGTA"),
        record("likeB", 0, "chrB", 21, "9M", "ACTTGACTA"),
        record("clip", 0, "chrB", 23, "2S2M1D2M", "NNGTAC"),
        record("cut", 0, "chrB", 21, "3M3D4M", "ACGCGTA"),
        record("over", 0, "chrB", 18, "7M", "TTTACGT"),
        record("low", 0, "chrB", 21, "4M", "ACGT", "I#II"),
        record("twice", 0, "chrB", 21, "4M", "ACGT"),
        record("other", 0, "chrB", 21, "4M", "ACGT"),
        record("lost", 0, "chrB", 21, "4M", "ACGT"),
    ]
    head = "@SQ\tSN:chrA\tLN:100\n@SQ\tSN:chrB\tLN:100\n@PG\tID:x\n"
    return refs, ref_sam, write("a.sam", head + "\n".join(a) + "\n"), write("b.sam", head + "\n".join(b) + "\n")


def test_prepare(spark, files, tmp_path):
    r = prepare_alignment(spark, *files, pileup_path=str(tmp_path / "out"), universal_path=str(tmp_path / "uni"), fastq_path=str(tmp_path / "fq"))
    assert r.universal.first()["seq"] == "MMMMIMMJMM"
    columns = {x["col"]: (x["pos_a"], x["pos_b"]) for x in r.columns.collect()}
    assert columns[0] == (11, 21) and columns[4] == (None, 25) and columns[5] == (15, 26) and columns[7] == (17, None) and columns[9] == (19, 29)
    reads = {x["name"]: x for x in r.reads.collect()}
    assert set(reads) == {"same", "likeB", "clip", "cut", "over", "low"}
    assert reads["same"]["genome"] == "A" and reads["likeB"]["genome"] == "B"
    assert [x["name"] for x in sorted(reads.values(), key=lambda x: x["read_id"])] == ["same", "likeB", "clip", "cut", "over", "low"]
    rows = {}
    for x in r.pileup.orderBy("read_id", "ref_pos").collect():
        rows.setdefault(x["read_id"], []).append((x["read_pos"], x["ref_pos"], x["qua"], x["nuc"]))
    same = rows[reads["same"]["read_id"]]
    assert [x[3] for x in same] == list("ACGT-ACGTA")
    assert [x[0] for x in same] == [0, 1, 2, 3, 3, 4, 5, 6, 7, 8]
    like_b = rows[reads["likeB"]["read_id"]]
    assert "".join(x[3] for x in like_b) == "ACTTGAC-TA"
    over = rows[reads["over"]["read_id"]]
    assert (over[0][0], over[0][1], over[0][3]) == (3, 0, "A") and len(over) == 4
    low = rows[reads["low"]["read_id"]]
    assert low[1] == (1, 1, -1, "-")
    cut = rows[reads["cut"]["read_id"]]
    assert [x[3] for x in cut][:4] == ["A", "C", "G", "-"]
    report = {(x["file"], x["reason"]): x["n"] for x in r.report.collect()}
    assert report[("a", "unmapped")] == 1
    back = pileup.read_pileup(spark, str(tmp_path / "out" / "region=0")) if (tmp_path / "out" / "region=0").exists() else None
    written = spark.read.csv(str(tmp_path / "out"), sep=" ", schema=pileup.SCHEMA + ", region long")
    assert written.count() == r.pileup.count() and (back is None or back.count())
    back = pileup.read_universal(spark, str(tmp_path / "uni")).orderBy("ref_pos").collect()
    assert "".join(x["symbol"] for x in back) == "MMMMIMMJMM" and [x["ref_pos"] for x in back] == list(range(10)) and {x["region"] for x in back} == {r.universal.first()["region"]}
    again = pileup.read_pileup(spark, str(tmp_path / "out"))
    assert again.count() == r.pileup.count() and {x["region"] for x in again.select("region").distinct().collect()} == {r.universal.first()["region"]}
    single = tmp_path / "one.fa"
    single.write_text(">uni_genome\nMM\nIJ\n")
    assert [(x["region"], x["symbol"]) for x in pileup.read_universal(spark, str(single), 7).orderBy("ref_pos").collect()] == [(7, c) for c in "MMIJ"]
    assert fastx.read_fastq(spark, str(tmp_path / "fq")).count() == len(reads)


def test_reversed_genome(spark, tmp_path):
    refs = tmp_path / "r.fa"
    refs.write_text(">chrA:0-6\nACGTAC\n>chrB:0-7\nACGTAC\n")
    (tmp_path / "r.sam").write_text("@SQ\tSN:chrA:0-6\tLN:6\nchrB:0-7\t16\tchrA:0-6\t1\t255\t6M\t*\n")
    head = "@SQ\tSN:chrA\tLN:9\n@SQ\tSN:chrB\tLN:9\n"
    (tmp_path / "a.sam").write_text(head + record("x", 0, "chrA", 1, "6M", "ACGTAC") + "\n")
    (tmp_path / "b.sam").write_text(head + record("x", 16, "chrB", 1, "6M", "GTACGT") + "\n")
    r = prepare_alignment(spark, str(refs), *[str(tmp_path / f"{n}.sam") for n in "rab"])
    assert [x["pos_b"] for x in r.columns.orderBy("col").collect()] == [6, 5, 4, 3, 2, 1]
    only = r.reads.first()
    assert only["name"] == "x" and only["strand"] == 0 and only["ll_a"] == pytest.approx(only["ll_b"])


def test_missing_files(spark, files):
    with pytest.raises(FileNotFoundError):
        prepare_alignment(spark, files[0], files[1], files[2], "/nowhere/b.sam")
    with pytest.raises(ValueError):
        prepare_alignment(spark, files[2], files[1], files[2], files[3])


def test_no_read_on_a_target_is_an_error(spark, files, tmp_path):
    lost = tmp_path / "lost.sam"
    lost.write_text("@SQ\tSN:chrB\tLN:99\n" + record("other", 0, "chrX", 21, "4M", "ACGT") + "\n" + record("away", 0, "chrB", 70, "4M", "ACGT") + "\n")
    with pytest.raises(ValueError, match="no read of B"):
        prepare_alignment(spark, files[0], files[1], files[2], str(lost))
    assert prepare_alignment(spark, *files).missing.isEmpty()


def test_from_files_to_haplotypes(spark, tmp_path):
    """A target of 60 columns, four haplotypes, two of either sub-genome, that three columns tell apart; reads of 30 bases, each on the right one."""
    rng = np.random.default_rng(4)
    a = rng.choice(list("ACGT"), 60)
    b = a.copy()
    other = {"A": "G", "G": "A", "C": "T", "T": "C"}
    for k in (14, 30, 46):
        b[k] = other[b[k]]
    haps = [a.copy(), a.copy(), b.copy(), b.copy()]
    haps[1][22], haps[3][38] = other[haps[1][22]], other[haps[3][38]]
    write = lambda name, lines: (tmp_path / name).write_text("\n".join(lines) + "\n") and str(tmp_path / name)
    refs = write("refs.fa", [">chrA:0-60", "".join(a), ">chrB:0-60", "".join(b)])
    ref_sam = write("refs.sam", ["@SQ\tSN:chrA:0-60\tLN:60", "chrB:0-60\t0\tchrA:0-60\t1\t255\t60M\t*", "*"])
    sides = {"a": ["@SQ\tSN:chrA\tLN:60"], "b": ["@SQ\tSN:chrB\tLN:60"]}
    for n in range(160):
        h, s = n % 4, int(rng.integers(0, 31))
        seq = "".join(haps[h][s : s + 30])
        for side, name in (("a", "chrA"), ("b", "chrB")):
            sides[side].append(record(f"H{h}-{n}", 0, name, s + 1, "30M", seq))
    sams = [write(f"{k}.sam", v) for k, v in sides.items()]
    got = genotype(spark, refs, ref_sam, *sams, str(tmp_path / "all"), Options(cut_off=0.1, min_reads=2))
    runs = got.result.runs.collect()
    assert [r["status"] for r in runs] == ["phased"] and got.prepared.reads.count() == 160
    truth = got.prepared.reads.select("region", "read_id", F.substring("name", 2, 1).cast("int").alias("true_hap"))
    assert phase.accuracy(got.result.assignments, truth).first()["accuracy"] >= 0.8  # reads that miss the site of their sub-genome are either
    called = spark.read.parquet(str(tmp_path / "all" / "result" / "haplotypes"))
    assert called.count() == 60 and (tmp_path / "all" / "universal").exists()


def test_sam_scan_and_filters(spark, files):
    rows = sam.read_sam(spark, files[2])
    assert rows.count() == 11
    assert [x["rname"] for x in sam.read_header(spark, files[2]).orderBy("line").collect()] == ["chrA", "chrB"]
    o = Options(drop_soft_clipped=2, drop_indel=2, min_length=5, max_eerr=0.5)
    found = {(x["name"], x["reason"]) for x in sam.reasons(rows, o).collect()}
    assert ("lost", "unmapped") in found and ("clip", "clipped") in found and ("cut", "indel") in found and ("onlyA", "short") in found and ("same", None) in found
    table = sam.base_table(rows.filter("name = 'likeB'")).orderBy("read_pos").collect()
    assert [x["ref_pos"] for x in table] == [10, 11, 12, 13, -1, 14, 15, 16, 17, 18]


def test_sam_sink(spark, tmp_path):
    """Every part of the file is a whole SAM file, and records come back as they were."""
    rows = [(f"r{i}", 16 * (i % 2), f"c{i % 3}", i + 1, "4M", "ACGT", "IIII") for i in range(50)] + [("lost", 4, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "name string, flag int, rname string, pos long, cigar string, seq string, qual string")
    header = spark.createDataFrame([(f"c{k}", 100 + k) for k in range(3)], "rname string, length long")
    sam.write_sam(frame.repartition(4), header, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert len(parts) == 4
    for p in parts:
        assert [(r["rname"], r["length"]) for r in sam.read_header(spark, str(p)).orderBy("line").collect()] == [("c0", 100), ("c1", 101), ("c2", 102)]
    back = sam.read_sam(spark, str(tmp_path / "out")).collect()
    assert sorted((r["name"], r["flag"], r["pos"], r["seq"]) for r in back if r["name"] != "lost") == sorted((r[0], r[1], r[3], r[5]) for r in rows[:-1]) and len(back) == 51


def test_fastq_policies(spark, tmp_path):
    path = tmp_path / "x.fq"
    path.write_text("@r1 a\nACGT\n+\n@III\n@r2\nACNT\n+\nIIII\n@r3\nA!GT\n+\nIIII\n@r4\nACGTACGT\n+\nIIIIIIII\n")
    names = lambda **k: sorted(x["name"] for x in fastx.read_fastq(spark, str(path), **k).collect())
    assert names() == ["r1", "r2", "r4"]
    assert names(ambiguous="drop_read") == ["r1", "r4"]
    assert names(max_length=4) == ["r1", "r2"]
    dropped = {x["name"]: x["seq"] for x in fastx.read_fastq(spark, str(path), ambiguous="drop_nuc").collect()}
    assert dropped["r2"] == "ACT"
    with pytest.raises(ValueError):
        fastx.read_fastq(spark, str(path), ambiguous="abort")
    switched = {x["name"]: (x["encoding"], x["codes"]) for x in fastx.read_fastq(spark, str(path), ambiguous="switch").collect()}
    assert switched["r2"] == ("iupac", [1, 2, 15, 8]) and switched["r1"] == ("iupac", [1, 2, 4, 8])
    plain = fastx.read_fastq(spark, str(path), ambiguous="switch", min_length=5)
    assert plain.count() == 1
    (tmp_path / "y.fq").write_text("@r1\nACGT\n+\nIIII\n")
    assert fastx.read_fastq(spark, str(tmp_path / "y.fq"), ambiguous="switch").select("encoding", "codes").first()[1] == [0, 1, 3, 2]
    seen = fastx.quality_range(fastx.read_fastq(spark, str(path))).first()
    assert (seen["lowest"], seen["highest"]) == (31, 40)


def test_codecs(spark):
    row = spark.createDataFrame([("ACGTN", "5S3M2D1I4M", "chr1:a:5-90")], "s string, c string, r string")
    ops = codec.parse_cigar(F.col("c"))
    got = row.select(codec.reverse_complement(F.col("s")).alias("rc"), codec.reference_length(ops).alias("ref"), codec.query_length(ops).alias("q"), codec.split_region(F.col("r")).alias("g"), codec.iupac_code(F.lit("n")).alias("n"), codec.iupac_char(F.lit(5)).alias("five")).first()
    assert (got["rc"], got["ref"], got["q"], got["n"], got["five"]) == ("NACGT", 9, 13, 15, "R")
    assert tuple(got["g"]) == ("chr1:a", 5, 90)
