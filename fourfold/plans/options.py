"""Options of the preparation and of phasing, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Options:
    """Shares are between 0 and 1. None switches a filter off. min_reads: reads that must carry a pattern of alleles, as far as each of them goes, for it to count in a window. emprical 0: windows take sampled haplotypes (n_sample rounds, up to a share lower_ab of all) instead of completed reads; sampling 1: reads are completed by every observed allele, and no site of two nucleotides is monomorphic."""

    majority: float = 0.9
    cut_off: float = 0.0
    three_hap: float = 0.55
    third_nuc: int = 0
    two_hap: float = 0.45
    left_range: float = 1.2
    emprical: int = 1
    sampling: int = 0
    n_sample: int = 10
    lower_ab: float = 0.95
    single: int = 0
    no_emi_update: int = 1
    dbheter: int = 0
    db_penal: float = 0.5
    qual_filter: int = 12
    drop_unmapped: bool = True
    drop_secondary: bool = True
    secondary_flag: int = 0x800
    drop_soft_clipped: int | None = None
    drop_indel: int | None = None
    min_length: int | None = None
    max_length: int | None = None
    max_eerr: float | None = None
    max_iter: int = 20
    tol: float = 1e-5
    seed: int = 0
    max_states: int = 10_000
    min_reads: int = 1

    def having(self, **values) -> Options:
        """A copy with other values; unknown names and values of another type are errors."""
        known = {f.name: f for f in fields(self)}
        for name, value in values.items():
            if name not in known:
                raise KeyError(f"no option is named {name}")
            now = getattr(self, name)
            fits = (bool,) if isinstance(now, bool) else (int,) if isinstance(now, int) else (float, int)
            if now is not None and value is not None and (not isinstance(value, fits) or isinstance(value, bool) and bool not in fits):
                raise TypeError(f"{name} takes {type(now).__name__}, not {type(value).__name__}")
        return replace(self, **values)
