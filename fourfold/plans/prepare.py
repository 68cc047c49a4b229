"""Preparation: alignments of the same reads to two sub-genomes become a pileup on universal columns, and a universal genome."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from fourfold.functions import codec
from fourfold.operators import project, targets
from fourfold.operators.keep import cut
from fourfold.plans.options import Options
from fourfold.sources import fastx, sam
from fourfold.sources.pileup import write_pileup, write_universal


@dataclass
class Prepared:
    """pileup: region, read_id, read_pos, ref_pos, qua, nuc; universal: region, name, seq; columns: of each target; reads:
    which alignment was chosen for each read, with its name; report: records left out, by file and reason; missing: region
    and file of targets that no read of the file lies on."""

    pileup: DataFrame
    universal: DataFrame
    columns: DataFrame
    reads: DataFrame
    report: DataFrame
    missing: DataFrame


def check_path(spark: SparkSession, path: str, endings: tuple[str, ...]) -> str:
    """A path must end as its format does and exist, in whatever file system Spark finds it."""
    if not path.lower().endswith(endings):
        raise ValueError(f"{path}: must end in {', '.join(endings)}")
    try:
        spark.read.text(path)
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    return path


def prepare_alignment(spark: SparkSession, references: str, ref_sam: str, sam_a: str, sam_b: str, options: Options | None = None, pileup_path: str | None = None, universal_path: str | None = None, fastq_path: str | None = None) -> Prepared:
    """Read the files, keep reads aligned once to each sub-genome of a target, and take the likelier alignment of each.

    references: FASTA with the aligned sequences, B's after A's; ref_sam: the alignment of B's regions to A's; sam_a,
    sam_b: the reads on either genome. All targets of ref_sam are done at once; a target's number is its region. Where
    every target lacks reads in one file or the other that is an error.
    """
    o = options or Options()
    check_path(spark, references, (".fsa", ".fa", ".fasta"))
    for p in (ref_sam, sam_a, sam_b):
        check_path(spark, p, (".sam",))
    table = cut(targets.target_table(sam.read_sam(spark, ref_sam).filter(F.col("flag").bitwiseAND(o.secondary_flag) == 0)))
    seqs = fastx.read_fasta(spark, references).select("name", "seq")
    pairs = table.join(seqs.withColumnsRenamed({"name": "region_a", "seq": "seq_a"}), "region_a").join(seqs.withColumnsRenamed({"name": "region_b", "seq": "seq_b"}), "region_b")
    lead = F.get("ops", F.lit(0))
    clip = F.coalesce(F.when(lead["op"].isin("S", "H"), lead["len"]), F.lit(0))
    back = F.col("strand_b") == 1
    # Coordinates count from 1; a reversed B begins one base before its region's end, as the format's users expect.
    pairs = pairs.withColumn("first_a", F.col("start_a") + F.col("pos")).withColumn("first_b", F.when(back, F.col("end_b") - 1 - clip).otherwise(F.col("start_b") + 1 + clip)).withColumn("step_b", F.when(back, -1).otherwise(1))
    columns = cut(project.universal_columns(pairs))
    sides, reports = {}, []
    for side, path in (("a", sam_a), ("b", sam_b)):
        rows = sam.reasons(sam.read_sam(spark, path), o)
        reports.append(sam.report(rows).withColumn("file", F.lit(side)))
        mapped = rows.filter("reason is null").withColumn("rs", F.col("pos") - 1).withColumn("re", F.col("pos") - 1 + codec.reference_length(F.col("ops")))
        regions = table.select("target", F.col(f"name_{side}").alias("rname"), F.col(f"start_{side}").alias("s"), F.col(f"end_{side}").alias("e"))
        where = targets.first_target(mapped.select("line", "rname", "rs", "re"), regions, ["line"], ["rname"])
        strand = F.shiftright(F.col("flag"), 4).bitwiseAND(1)
        flip = table.select("target", (F.col("strand_b") if side == "b" else F.lit(0)).alias("flip"))
        placed = mapped.join(where, "line").join(flip, "target").withColumn("strand", strand.bitwiseXOR(F.col("flip")))
        sides[side] = cut(placed.select("target", "line", "name", "strand", "flip", "pos", "ops", "seq", "qual"))
    lacking = [table.select("target").join(sides[s].select("target"), "target", "left_anti").select(F.col("target").alias("region"), F.lit(s).alias("file")) for s in sides]
    missing = cut(lacking[0].unionByName(lacking[1]))
    if table.select("target").join(missing.select(F.col("region").alias("target")), "target", "left_anti").isEmpty():
        raise ValueError(f"no read of {', '.join(r['file'].upper() for r in missing.select('file').distinct().orderBy('file').collect())} lies on a target of {ref_sam}")
    key = ["target", "name", "strand"]
    counts = targets.merge_files(sides["a"], sides["b"], key).filter("kept").select(*key)
    kept = counts.join(sides["a"].select(*key, F.col("line").alias("line_a")), key).join(sides["b"].select(*key, F.col("line").alias("line_b")), key)
    kept = cut(kept)
    laid, scores = {}, {}
    for side in ("a", "b"):
        own = sides[side].join(kept.select("target", F.col(f"line_{side}").alias("line")), ["target", "line"], "left_semi")
        cols = columns.select("target", "col", "symbol", F.col(f"pos_{side}").alias("pos"), F.col(f"base_{side}").alias("base"))
        laid[side] = cut(project.project(own, cols, F.col("flip") == 1))
        scores[side] = project.score(laid[side])
    chosen = cut(project.choose(kept, scores["a"], scores["b"], o.seed))
    parts = [laid[s].join(chosen.filter(F.col("genome") == s.upper()).select("target", F.col(f"line_{s}").alias("line"), "read_id"), ["target", "line"]) for s in ("a", "b")]
    pileup = project.pileup_rows(parts[0].unionByName(parts[1]), o.qual_filter)
    symbols = columns.groupBy("target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "symbol"))), lambda x: x["symbol"]), "").alias("seq"))
    universal = symbols.select(F.col("target").alias("region"), F.lit("uni_genome").alias("name"), "seq")
    if pileup_path:
        write_pileup(pileup, pileup_path)
    if universal_path:
        write_universal(universal, universal_path)
    if fastq_path:
        fastx.write_fastq(sides["a"].join(chosen.select("target", F.col("line_a").alias("line")), ["target", "line"], "left_semi"), fastq_path)
    return Prepared(pileup, universal, columns, chosen.select(F.col("target").alias("region"), "read_id", "name", "strand", "genome", "ll_a", "ll_b"), reports[0].unionByName(reports[1]), missing)
