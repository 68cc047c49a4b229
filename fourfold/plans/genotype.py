"""From files to haplotypes in one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from fourfold.plans.options import Options
from fourfold.plans.phase import Result, phase, write_result
from fourfold.plans.prepare import Prepared, prepare_alignment
from fourfold.sources import pileup


@dataclass
class Genotyped:
    """What the preparation and the phasing of all targets gave."""

    prepared: Prepared
    result: Result


def phase_files(spark: SparkSession, pileup_path: str, universal_path: str | None = None, options: Options | None = None, out: str | None = None) -> Result:
    """Phase a pileup as text, with the symbols of its universal genome; a file, or what the preparation has written."""
    bases = pileup.bases(pileup.read_pileup(spark, pileup_path))
    symbols = None if universal_path is None else pileup.read_universal(spark, universal_path)
    result = phase(bases, options, symbols)
    if out:
        write_result(result, out)
    return result


def genotype(spark: SparkSession, references: str, ref_sam: str, sam_a: str, sam_b: str, out: str, options: Options | None = None) -> Genotyped:
    """Prepare the alignments of reads to both sub-genomes and phase all targets; everything is written to the folder `out`.

    The folder gets `pileup` and `universal` as text and the tables of the result as Parquet.
    """
    prepared = prepare_alignment(spark, references, ref_sam, sam_a, sam_b, options, f"{out}/pileup", f"{out}/universal")
    return Genotyped(prepared, phase_files(spark, f"{out}/pileup", f"{out}/universal", options, f"{out}/result"))
