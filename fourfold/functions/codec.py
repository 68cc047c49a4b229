"""Nucleotide and quality codecs as column expressions.

Two-bit codes are A=0, C=1, T=2, G=3; IUPAC codes are sets of A=1, C=2, G=4, T=8; qualities are ASCII less 33.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC letters by their bit sets.
IUPAC = {"A": 1, "C": 2, "M": 3, "G": 4, "R": 5, "S": 6, "V": 7, "T": 8, "W": 9, "Y": 10, "H": 11, "K": 12, "D": 13, "B": 14, "N": 15}
NUCLEOTIDES = ("A", "C", "T", "G")
COMPLEMENT_FROM, COMPLEMENT_TO = "ACGTUacgtu", "TGCAAtgcaa"


def xy_code(char: Column) -> Column:
    """0 to 3 for a nucleotide of either case (U as T), null for anything else."""
    return F.when(char.rlike("^[ACGTUacgtu]$"), F.shiftright(F.ascii(char), 1).bitwiseAND(3))


def xy_char(code: Column, missing: str = "N") -> Column:
    """The letter of a two-bit code; null, -1 and 4 give `missing`."""
    return F.when(code.between(0, 3), F.element_at(F.array(*map(F.lit, NUCLEOTIDES)), code.cast("int") + 1)).otherwise(F.lit(missing))


def iupac_code(char: Column) -> Column:
    """Bit set of an IUPAC letter of either case, U as T and X as N; null for anything else."""
    table = F.create_map(*[F.lit(x) for pair in (IUPAC | {"U": 8, "X": 15}).items() for x in pair])
    return F.element_at(table, F.upper(char))


def count_letters(text: Column, letters: str) -> Column:
    """How many characters of a text are one of some letters; the text stays whole, nothing is spread over rows."""
    return (F.length(text) - F.length(F.translate(text, letters, ""))).cast("long")


def xy_counts(text: Column) -> list[Column]:
    """n0 to n3: how often each two-bit code stands in a text, and n_other: characters that have none."""
    found = [count_letters(text, letters) for letters in ("Aa", "Cc", "TtUu", "Gg")]
    return [*[c.alias(f"n{k}") for k, c in enumerate(found)], (F.length(text).cast("long") - sum(found[1:], found[0])).alias("n_other")]


def iupac_counts(text: Column) -> list[Column]:
    """n_valid, n_options, n_plain: IUPAC letters in a text, nucleotides that they may stand for in all, and letters of one nucleotide."""
    by_size: dict[int, str] = {}
    for letter, bits in (IUPAC | {"U": 8, "X": 15}).items():
        by_size[bits.bit_count()] = by_size.get(bits.bit_count(), "") + letter + letter.lower()
    found = {k: count_letters(text, letters) for k, letters in by_size.items()}
    total = sum(list(found.values())[1:], next(iter(found.values())))
    options = sum((c * k for k, c in found.items()), F.lit(0))
    return [total.alias("n_valid"), options.cast("long").alias("n_options"), found[1].alias("n_plain")]


def iupac_char(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in IUPAC.items() for x in (v, k)])
    return F.element_at(table, code.cast("int"))


def xy_to_iupac(code: Column) -> Column:
    return F.when(code.between(0, 3), F.element_at(F.array(F.lit(1), F.lit(2), F.lit(8), F.lit(4)), code.cast("int") + 1))


def iupac_to_xy(code: Column) -> Column:
    """The two-bit code of an unambiguous IUPAC code, else null."""
    return F.when(code == 1, 0).when(code == 2, 1).when(code == 8, 2).when(code == 4, 3)


def letter_codes(seq: Column, encoding: str) -> Column:
    """The codes of all letters of a sequence, two-bit (`xy`) or IUPAC sets (`iupac`)."""
    one = {"xy": xy_code, "iupac": iupac_code}[encoding]
    return F.transform(F.filter(F.split(seq, ""), lambda c: c != ""), lambda c: one(c).cast("int"))


def iupac_options(code: Column) -> Column:
    return F.bit_count(code)


def complement(seq: Column) -> Column:
    return F.translate(seq, COMPLEMENT_FROM, COMPLEMENT_TO)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def is_nucleotide(seq: Column) -> Column:
    return seq.rlike("^[ACGTUacgtu]*$")


def is_iupac(seq: Column) -> Column:
    return seq.rlike("^[ACGTUMRWSYKVHDBNXacgtumrwsykvhdbnx]*$")


def phred(char: Column) -> Column:
    return F.ascii(char) - 33


def phred_char(quality: Column) -> Column:
    return F.char(quality + 33)


def censored_phred(char: Column, least: int, most: int) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), phred(char)))


def error_probability(quality: Column) -> Column:
    return F.pow(F.lit(10.0), -quality / 10.0)


def log_error_probability(quality: Column) -> Column:
    return -quality / 10.0 * math.log(10.0)


def qualities(text: Column) -> Column:
    """A quality string as an array of numbers."""
    chars = F.split(text, "")
    return F.transform(F.filter(chars, lambda c: c != ""), phred)


def expected_errors(text: Column) -> Column:
    return F.aggregate(qualities(text), F.lit(0.0), lambda a, q: a + error_probability(q))


def text_errors(text: Column) -> Column:
    """Expected errors of any text taken as a quality string, and its characters from ! to ~, which alone count: a struct of expected and n."""
    counts = F.filter(F.split(text, ""), lambda c: (c >= "!") & (c <= "~") & (F.length(c) == 1))
    start = F.struct(F.lit(0.0).alias("expected"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(counts, start, lambda a, c: F.struct((a["expected"] + error_probability(phred(c))).alias("expected"), (a["n"] + 1).alias("n")))


def error_free_probability(text: Column) -> Column:
    return F.aggregate(qualities(text), F.lit(1.0), lambda a, q: a * (1 - error_probability(q)))


def substitution_probability(read: Column, true: Column, quality: Column, log: bool = False) -> Column:
    """Chance of reading `read` where the base is `true`: 1 - e if they are equal, else e / 3."""
    e = error_probability(quality)
    if log:
        return F.when(read == true, F.log1p(-e)).otherwise(log_error_probability(quality) - math.log(3.0))
    return F.when(read == true, 1 - e).otherwise(e / 3)


def ambiguous_log_probability(read: Column, iupac: Column, quality: Column) -> Column:
    """As above, in logs, for an IUPAC base: the mean over what it may stand for."""
    e = error_probability(quality)
    n = F.bit_count(iupac)
    hit = (iupac.bitwiseAND(xy_to_iupac(read)) != 0).cast("int")
    mean = (hit * (1 - e) + (n - hit) * e / 3) / n
    return F.when(n == 1, F.when(hit == 1, F.log1p(-e)).otherwise(log_error_probability(quality) - math.log(3.0))).otherwise(F.log(mean))


def log_factorial(n: Column, most: int = 2000) -> Column:
    """ln n! for 0 <= n <= most, added up exactly; Stirling's series beyond."""
    exact = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), n.cast("int"))), F.lit(0.0), lambda a, k: a + F.log(k.cast("double")))
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x)
    return F.when(n <= most, exact).otherwise(series)


def poisson_gap_penalty(gaps: Column, length: Column, rate: float = 1e-5) -> Column:
    """Log Poisson mass of the gaps in an alignment of a length; no penalty without gaps."""
    mean = rate * length
    return F.when(gaps > 0, gaps * F.log(mean) - mean - log_factorial(gaps)).otherwise(F.lit(0.0))


def region_name(name: Column, start: Column, end: Column, delimiters: tuple[str, str] = (":", "-")) -> Column:
    return F.concat(name, F.lit(delimiters[0]), start.cast("string"), F.lit(delimiters[1]), end.cast("string"))


def split_region(text: Column) -> Column:
    """name, start and end of `name:start-end`; the name may hold delimiters itself."""
    pattern = r"^(.*):(\d+)-(\d+)$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    return F.when(text.rlike(pattern), F.struct(part(1).alias("name"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end")))


def parse_cigar(cigar: Column) -> Column:
    """array<struct<op,len>> of a CIGAR string; `*` and null give an empty array."""
    marks = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit(r"\d+[MIDNSHP=X]"), F.lit(0))
    return F.transform(marks, lambda m: F.struct(F.substring(m, -1, 1).alias("op"), F.regexp_extract(m, r"^\d+", 0).cast("int").alias("len")))


def consumed(ops: Column, kinds: str) -> Column:
    """Sum of the lengths of operations of some kinds."""
    return F.aggregate(ops, F.lit(0), lambda a, o: a + F.when(F.instr(F.lit(kinds), o["op"]) > 0, o["len"]).otherwise(0))


def reference_length(ops: Column) -> Column:
    return consumed(ops, "MDN=X")


def query_length(ops: Column) -> Column:
    return consumed(ops, "MIS=X")


def clipped(ops: Column, start: Column, lo: Column, hi: Column) -> Column:
    """The operations of an alignment that begins at `start`, with all that lies outside [lo, hi) of the reference as soft clips.

    What is left begins at lo. Bases cut off, and insertions that no longer lie between bases, go into the clips at the
    ends, with those that were there; hard clips stay outside them. One fold over the operations; lo is no less than start.
    """
    kinds = "array<struct<op:string,len:int>>"
    first = F.struct(start.cast("int").alias("at"), F.lit(0).alias("left"), F.lit(0).alias("right"), F.lit(0).alias("hard_left"), F.lit(0).alias("hard_right"), F.array().cast(kinds).alias("out"))
    lo, hi = lo.cast("int"), hi.cast("int")

    def step(a: Column, o: Column) -> Column:
        op, size, at = o["op"], o["len"], a["at"]
        on_reference, on_read = F.instr(F.lit("MDN=X"), op) > 0, F.instr(F.lit("MIS=X"), op) > 0
        none = F.lit(0)
        before = F.when(on_reference, F.least(size, F.greatest(none, lo - at)))
        kept = F.when(on_reference, F.greatest(none, F.least(at + size, hi) - F.greatest(at, lo))).when((op == "I") & (at > lo) & (at < hi), size).otherwise(none)
        ahead = F.when(on_reference, before).when(at <= lo, size - kept).otherwise(none)
        behind = size - kept - ahead
        return F.struct(
            (at + F.when(on_reference, size).otherwise(none)).alias("at"),
            (a["left"] + F.when(on_read, ahead).otherwise(none)).alias("left"), (a["right"] + F.when(on_read, behind).otherwise(none)).alias("right"),
            (a["hard_left"] + F.when(op == "H", ahead).otherwise(none)).alias("hard_left"), (a["hard_right"] + F.when(op == "H", behind).otherwise(none)).alias("hard_right"),
            F.concat(a["out"], F.when(kept > 0, F.array(F.struct(op.alias("op"), kept.alias("len")))).otherwise(F.array().cast(kinds))).alias("out"))

    def end(a: Column) -> Column:
        part = lambda n, op: F.when(n > 0, F.array(F.struct(F.lit(op).alias("op"), n.alias("len")))).otherwise(F.array().cast(kinds))
        return F.concat(part(a["hard_left"], "H"), part(a["left"], "S"), a["out"], part(a["right"], "S"), part(a["hard_right"], "H"))

    return F.aggregate(ops, first, step, end)


def cigar_text(ops: Column) -> Column:
    """Operations as a CIGAR string, `*` if there are none."""
    text = F.array_join(F.transform(ops, lambda o: F.concat(o["len"].cast("string"), o["op"])), "")
    return F.when(text == "", "*").otherwise(text)


def longest(ops: Column, kinds: str) -> Column:
    """The longest operation of some kinds; 0 if there is none."""
    found = F.transform(F.filter(ops, lambda o: F.instr(F.lit(kinds), o["op"]) > 0), lambda o: o["len"])
    return F.coalesce(F.array_max(found), F.lit(0))
