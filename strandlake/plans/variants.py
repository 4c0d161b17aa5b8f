"""From files to reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, grouping, observations, pileup, reports
from ..sources import files
from ..sources.local import cut


class Run:
    """One set of inputs; each report is a plan over shared steps.

    Lines, grouped placements and positions feed several reports and plans of their own
    size, so each is written once, as a table in the folder that all executors share."""

    def __init__(self, spark: SparkSession, sams: Sequence[str], references: Sequence[str], ordered: bool = True, end_fraction: float = 0.1, support: bool = True, extended_cigar: bool = False):
        self.spark, self.support, self.fraction = spark, support, end_fraction
        self.reference = files.read_reference(spark, references)
        self.parsed = files.parse_sam(files.read_sam_lines(spark, sams))
        self.components = cut(files.kept(self.parsed), "components")
        self.aligned = cut(grouping.alignments(self.components, ordered), "aligned")
        self.grouped = cut(grouping.query_groups(self.aligned), "grouped")
        self.blocked = observations.with_blocks(self.grouped, extended_cigar)
        self._positions: DataFrame | None = None

    def positions(self) -> DataFrame:
        if self._positions is None:
            obs = observations.base_observations(self.blocked, self.reference, self.fraction)
            piled = pileup.with_absences(pileup.pileup(obs, self.support))
            self._positions = cut(pileup.positions(piled, self.support), "positions")
        return self._positions

    def vcf(self, thresholds: filters.Thresholds = filters.Thresholds(), only_mutations: bool = False) -> DataFrame:
        return reports.vcf_rows(filters.filtered_positions(self.positions(), thresholds), only_mutations, self.support)

    def mutations(self, thresholds: filters.Thresholds | None = None) -> DataFrame:
        return reports.mutation_rows(filters.filtered_positions(self.positions(), thresholds or filters.Thresholds.for_mutations()))

    def sam(self) -> DataFrame:
        return reports.sam_rows(self.blocked)

    def refs_map_count(self) -> DataFrame:
        return reports.refs_map_count(self.grouped, self.reference)

    def statistics(self) -> DataFrame:
        return reports.run_statistics(self.blocked, self.positions(), self.reference)

    def errors(self) -> int:
        return int(grouping.incomplete_groups(self.aligned).agg(F.coalesce(F.sum("errors"), F.lit(0))).first()[0])
