"""Options of the commands, with their defaults and checks."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from ..functions.bloom import MODES
from ..functions.dna import MOST_K
from ..operators.report import RANKS, TYPES


def _share(name: str, value: float) -> None:
    if not 0 <= value <= 1:
        raise ValueError(f"{name} lies between 0 and 1")


@dataclass
class Build:
    kmer: int = 19
    window: int = 31
    hash_functions: int = 4
    max_fp: float = 0.05
    filter_size_mb: float = 0.0
    mode: str = "avg"
    min_length: int = 0
    level: str = "target"
    keep_invalid_taxa: bool = False
    partitions: int = 64

    def check(self) -> None:
        if not 1 <= self.kmer <= MOST_K or self.window < self.kmer:
            raise ValueError(f"kmer lies between 1 and {MOST_K}, and window is not below it")
        if not 0 <= self.hash_functions <= 5:
            raise ValueError("hash_functions lies between 0 (chosen) and 5")
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        if bool(self.filter_size_mb) and self.filter_size_mb < 0 or not self.filter_size_mb and not 0 < self.max_fp < 1:
            raise ValueError("give a max_fp between 0 and 1 or a filter size")


@dataclass
class Level:
    """One hierarchy level: its databases' folders, a cutoff for each, and its filters."""

    label: str
    databases: list[str]
    rel_cutoff: list[float] = field(default_factory=lambda: [0.75])
    rel_filter: float = 0.1
    fpr_query: float = 1e-5

    def check(self) -> None:
        if not self.databases:
            raise ValueError("a level needs a database")
        for x in self.rel_cutoff:
            _share("rel_cutoff", x)
        _share("rel_filter", self.rel_filter)
        _share("fpr_query", self.fpr_query)

    def cutoffs(self) -> list[float]:
        if len(self.rel_cutoff) not in (1, len(self.databases)):
            raise ValueError("one cutoff, or one for each database")
        return self.rel_cutoff * len(self.databases) if len(self.rel_cutoff) == 1 else self.rel_cutoff


@dataclass
class Classify:
    multiple_matches: str = "em"
    output_all: bool = False
    output_one: bool = False
    output_unclassified: bool = False
    output_stats: bool = True
    output_single: bool = False
    max_iter: int = 10
    threshold: float = 0.0
    root: str = "1"
    #: Reads with more hashes are skipped: a 16-bit counter's limit, or a 32-bit one's for long reads.
    most_hashes: int = 65_535
    report: bool = True
    report_type: str = "abundance"
    min_count: float = 5e-5
    ranks: list[str] | None = field(default_factory=lambda: list(RANKS))

    def check(self) -> None:
        if self.multiple_matches not in ("em", "lca", "skip"):
            raise ValueError("multiple_matches is em, lca or skip")
        if self.max_iter < 0 or self.threshold < 0 or self.min_count < 0 or self.most_hashes < 1:
            raise ValueError("max_iter, threshold and min_count are not negative; most_hashes is positive")
        if self.report_type not in TYPES:
            raise ValueError(f"report_type is one of {', '.join(TYPES)}")


def binning(levels: list[Level], o: Classify | None = None) -> tuple[list[Level], Classify]:
    """The settings for counting reads per bin instead of estimating abundances."""
    return [replace(x, rel_cutoff=[0.25], rel_filter=0.0) for x in levels], replace(o or Classify(), min_count=0.0, report_type="reads")


@dataclass
class Report:
    report_type: str = "abundance"
    ranks: list[str] | None = field(default_factory=lambda: list(RANKS))
    sort: str = ""
    no_orphan: bool = False
    split_hierarchy: bool = False
    skip_hierarchy: list[str] = field(default_factory=list)
    keep_hierarchy: list[str] = field(default_factory=list)
    top_percentile: float = 0.0
    normalize: bool = False
    output_format: str = "tsv"
    min_count: float = 0.0
    max_count: float = 0.0
    taxids: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    names_with: list[str] = field(default_factory=list)

    def check(self) -> None:
        if self.report_type not in TYPES:
            raise ValueError(f"report_type is one of {', '.join(TYPES)}")
        if self.output_format not in ("tsv", "csv", "text", "bioboxes"):
            raise ValueError("output_format is tsv, csv, text or bioboxes")
        if self.skip_hierarchy and self.keep_hierarchy:
            raise ValueError("skip_hierarchy and keep_hierarchy exclude each other")
        _share("top_percentile", self.top_percentile)


@dataclass
class Table:
    output_value: str = "counts"
    top_sample: int = 0
    top_all: int = 0
    min_frequency: float = 0.0
    rank: str | None = None
    no_root: bool = False
    header: str = "name"
    unclassified_label: str | None = None
    filtered_label: str | None = None
    skip_zeros: bool = False
    transpose: bool = False
    min_count: float = 0.0
    max_count: float = 0.0
    taxids: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    names_with: list[str] = field(default_factory=list)

    def check(self) -> None:
        if self.output_value not in ("counts", "percentage") or self.header not in ("name", "taxid", "lineage"):
            raise ValueError("output_value is counts or percentage; header is name, taxid or lineage")
        if self.top_sample and self.top_all:
            raise ValueError("top_sample and top_all exclude each other")


def plain(options) -> dict:
    return asdict(options)
