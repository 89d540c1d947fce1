"""The merge job (#36): template + sources + decisions -> merged sheets + audit.

Stages (each a DataFrame; nothing is collected except the template header):

1. header-side matching and detection on ``headers``
2. one detection pass over ``rows`` (overflow, duplicate equality), and the
   first five rows of each sheet for samples
3. duplicate rule, decisions, column map, all header-sized
4. ONE alignment pass over ``rows`` per output (narrow, no shuffle when the
   column map is broadcast)

With ``materialize=True`` the intermediate tables that later stages reuse
(annotated header cells, sheet profile, detection facts, cancel list,
column map; all header-sized) are written once as Parquet to the shared
folder named by ``spark.checkpoint.dir`` and read back, so lineage is cut,
a lost executor never re-runs the detection pass, and each is computed
exactly once (``DataFrame.checkpoint`` would compute its input twice: once
to count, once to save). Sizes needed for broadcast decisions are observed
during those writes (``Observation``), not by extra jobs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sheetmerge.functions import is_blank, not_blank
from sheetmerge.model import DECISIONS, KIND_UNSELECTED, TEMPLATE_HEADERS
from sheetmerge.operators import audit, decisions as dec, detect, merge, resolve
from sheetmerge.operators.template import check_layout, template_layout, template_slots
from sheetmerge.plans.sizing import (
    DEFAULT_MAX_BROADCAST_BYTES,
    SheetStats,
    maybe_broadcast,
    measure_profile,
    profile_metrics,
    stats_from_metrics,
    template_side,
)
from sheetmerge.sources.land import land


@dataclass
class MergeResult:
    sheets: dict[str, DataFrame]  # template sheet -> merged rows, template column names
    merged_all: DataFrame | None  # (sheet, file, row_no, 表名, c1..): every merged row; None for a result read back
    exceptions: DataFrame  # 8-field exception table
    cancelled: DataFrame  # (file, reason)
    missing: DataFrame  # (file, sheet, name): template names a source lacks
    unmatched: DataFrame  # (file, sheet): source sheets with no template sheet


@dataclass
class DetectReport:
    exceptions: DataFrame  # anomalies with the operation the current decisions give
    choices_needed: DataFrame  # step-3 slots still without a chosen column
    missing: DataFrame
    unmatched: DataFrame


class MergePlan:
    """Lazily built stages of one merge; every attribute is a DataFrame."""

    def __init__(
        self,
        spark: SparkSession,
        template_headers: DataFrame,
        headers: DataFrame,
        rows: DataFrame,
        decisions: DataFrame | None = None,
        policy: dict[str, str] | str | None = None,
        materialize: bool = True,
        max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
        check_template: bool = True,
        failed: DataFrame | None = None,
    ):
        self.spark = spark
        self.template_headers = template_headers
        self.headers = headers
        self.rows = rows
        self.decisions = decisions if decisions is not None else spark.createDataFrame([], DECISIONS)
        self.policy = policy
        self.failed = failed  # (file, reason) of sources that couldn't be read
        self.materialize = materialize
        self.max_broadcast_bytes = max_broadcast_bytes
        self._profile_stats: SheetStats | None = None
        self._header_bytes: int | None = None
        if check_template:
            check_layout(self.layout)
        # The template header is collected once anyway (it defines the output
        # schema; bounded by 16,384 columns per sheet). Rebuilt as a local
        # relation, every join with it is a planned broadcast and its source
        # (a workbook parse) is never re-run.
        self.template_headers = spark.createDataFrame(
            [(s, i, n) for s, names in self.layout.items() for i, n in enumerate(names)], TEMPLATE_HEADERS
        )

    # -- helpers -------------------------------------------------------------
    def _keep(self, df: DataFrame, label: str) -> DataFrame:
        if not self.materialize:
            return df
        return land(self.spark, df, label)

    # -- template --------------------------------------------------------------
    @cached_property
    def layout(self) -> dict[str, list[str | None]]:
        return template_layout(self.template_headers)

    @cached_property
    def width(self) -> int:
        return max((len(v) for v in self.layout.values()), default=1)

    # -- header side: one annotated, landed table; the rest are filters of it ----
    @cached_property
    def cells(self) -> DataFrame:
        df = detect.annotate_headers(self.headers, self.template_headers)
        if not self.materialize:
            return df
        obs = Observation("header_cells")
        key_bytes = F.octet_length("file") + F.octet_length("sheet") + F.coalesce(F.octet_length("name"), F.lit(0))
        landed = land(self.spark, df.observe(obs, F.count(F.lit(1)).alias("n"), F.sum(key_bytes).alias("b")), "header-cells")
        got = obs.get
        self._header_bytes = int(got["n"]) * 96 + int(got["b"] or 0)
        return landed

    def _header_side(self, df: DataFrame) -> DataFrame:
        """Broadcast a table derived from the header cells when their measured
        size allows (without statistics the planner multiplies join inputs and
        picks shuffle joins for these small tables)."""
        self.cells
        if self._header_bytes is None:
            return df
        return maybe_broadcast(df, self._header_bytes, self.max_broadcast_bytes)

    @cached_property
    def occurrence(self) -> DataFrame:
        return self.cells.where(not_blank("name")).select("file", "sheet", "col_idx", "name", "occ", "n_s")

    @cached_property
    def counts(self) -> DataFrame:
        return self.cells.where((F.col("occ") == 1) & (F.col("n_t") >= 1)).select(
            "file", "sheet", "name", "n_s", "n_t"
        )

    @cached_property
    def widths(self) -> DataFrame:
        return self.profile.select("file", "sheet", "width")

    @cached_property
    def profile(self) -> DataFrame:
        df = detect.profile_from_cells(self.cells)
        if not self.materialize:
            return df
        obs = Observation("sheet_profile")
        landed = land(self.spark, df.observe(obs, *profile_metrics()), "profile")
        self._profile_stats = stats_from_metrics(obs.get)
        return landed

    @cached_property
    def matched(self) -> DataFrame:
        return self.profile.select("file", "sheet")

    @cached_property
    def stats(self) -> SheetStats:
        profile = self.profile
        return self._profile_stats if self._profile_stats is not None else measure_profile(profile)

    @cached_property
    def unmatched(self) -> DataFrame:
        return self.cells.where(~F.col("matched")).select("file", "sheet").distinct()

    @cached_property
    def missing(self) -> DataFrame:
        wanted = template_slots(self.template_headers).select("sheet", "name").distinct()
        return (
            self.matched.join(template_side(wanted), "sheet")
            .join(self.occurrence.select("file", "sheet", "name"), ["file", "sheet", "name"], "left_anti")
            .select("file", "sheet", "name")
        )

    @cached_property
    def extra(self) -> DataFrame:
        return self.cells.where(not_blank("name") & ~F.col("in_template") & F.col("matched")).select(
            "file", "sheet", "col_idx", "name"
        )

    @cached_property
    def blank(self) -> DataFrame:
        return self.cells.where(is_blank("name") & (F.col("col_idx") < F.col("width")) & F.col("matched")).select(
            "file", "sheet", "col_idx"
        )

    # -- the detection pass over rows ---------------------------------------------
    @cached_property
    def facts(self) -> DataFrame:
        profile = maybe_broadcast(self.profile, self.stats.profile_bytes(), self.max_broadcast_bytes)
        return self._keep(detect.scan_rows(self.rows, profile), "facts")

    @cached_property
    def overflow(self) -> DataFrame:
        return detect.overflow_columns(self.facts)

    # -- resolution -------------------------------------------------------------------
    @cached_property
    def rules(self) -> DataFrame:
        return resolve.dup_rule(self.counts, self.facts)

    @cached_property
    def choices(self) -> DataFrame:
        return resolve.valid_choices(self.occurrence, self.decisions)

    @cached_property
    def assignment(self) -> DataFrame:
        return resolve.slot_assignment(
            self.headers,
            self.template_headers,
            self._header_side(self.occurrence),
            self._header_side(self.rules),
            self._header_side(self.choices),
            self.matched,
        )

    @cached_property
    def mapping_all(self) -> DataFrame:
        """Column map of every matched sheet, cancelled files included (landed)."""
        m = resolve.column_map(
            self.occurrence,
            self.template_headers,
            self._header_side(self.rules.where(F.col("n_s") >= 2)),
            self._header_side(self.choices),
            self.matched,
        )
        return self._keep(m, "mapping")

    @cached_property
    def actions(self) -> DataFrame:
        """Every anomaly with what is done about it, before files are cancelled."""
        return dec.resolve_actions(self.anomalies, self.decisions, self.policy)

    @cached_property
    def cancelled(self) -> DataFrame:
        decided = dec.cancelled_files(self.decisions, self.cells)
        return self._keep(dec.files_to_cancel(decided, self.actions, self.failed), "cancelled")

    @cached_property
    def mapping(self) -> DataFrame:
        """What the alignment joins: the maps of files that aren't cancelled."""
        return self.mapping_all.join(self._header_side(self.cancelled.select("file")), "file", "left_anti")

    @cached_property
    def choices_needed(self) -> DataFrame:
        return resolve.dup_by_choice(self.assignment).where(F.col("col_idx").isNull())

    @cached_property
    def unselected(self) -> DataFrame:
        return resolve.unselected_columns(
            self.occurrence, self._header_side(self.rules), self._header_side(resolve.used_columns(self.mapping_all))
        )

    # -- audit ------------------------------------------------------------------------
    @cached_property
    def anomalies(self) -> DataFrame:
        return audit.anomaly_table(self.blank, self.overflow.drop("sample"), self.extra, self.unselected)

    @cached_property
    def with_operations(self) -> DataFrame:
        return dec.apply_decisions(self.anomalies, self.decisions, self.cancelled, self.policy)

    @cached_property
    def samples(self) -> DataFrame:
        return detect.probe_samples(self.facts).unionByName(self.overflow)

    @cached_property
    def exceptions(self) -> DataFrame:
        return audit.exception_records(self.with_operations, self.samples)

    # -- the alignment pass -------------------------------------------------------------
    @cached_property
    def aligned(self) -> DataFrame:
        mapping = maybe_broadcast(
            self.mapping, self.stats.mapping_bytes(self.width), self.max_broadcast_bytes
        )
        return merge.align(self.rows, mapping, self.width)

    @cached_property
    def sheet_stats(self) -> dict[str, SheetStats]:
        """Per template sheet: how many source sheets map into it (one small
        job over the landed profile; one row per template sheet comes back)."""
        got = self.profile.groupBy("sheet").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("file") + F.octet_length("sheet")).alias("k")
        )
        return {r["sheet"]: SheetStats(int(r["n"]), int(r["k"] or 0), 0) for r in got.collect()}

    def sheet(self, sheet: str) -> DataFrame:
        """One template sheet: its slice of the column map is broadcast when
        that slice is small enough, whatever the size of the whole map."""
        names = self.layout[sheet]
        est = self.stats.mapping_bytes(self.width)  # a slice is never bigger than the whole
        if est > self.max_broadcast_bytes:  # only then is it worth counting per sheet
            est = self.sheet_stats.get(sheet, SheetStats(0, 0, 0)).mapping_bytes(len(names))
        mapping = maybe_broadcast(self.mapping.where(F.col("sheet") == sheet), est, self.max_broadcast_bytes)
        aligned = merge.align(self.rows.where(F.col("sheet") == sheet), mapping, len(names))
        return merge.sheet_frame(aligned, sheet, names)

    def result(self) -> MergeResult:
        if self.policy == dec.POLICY_FAIL:
            bad = dec.unresolved(self.with_operations).limit(5).collect()
            # a slot without a choice is decided only where every column of its name has an answer
            undecided = self.actions.where((F.col("kind") == KIND_UNSELECTED) & F.col("decided").isNull())
            open_slots = self.choices_needed.join(undecided.select("file", "sheet", "name").distinct(), ["file", "sheet", "name"], "left_semi")
            open_slots = open_slots.join(self.cancelled.select("file"), "file", "left_anti").limit(5).collect()
            if bad or open_slots:
                raise ValueError(f"anomalies without a decision: {[r.asDict() for r in bad + open_slots]}")
        return MergeResult(
            sheets={s: self.sheet(s) for s in self.layout},
            merged_all=self.aligned,
            exceptions=self.exceptions,
            cancelled=self.cancelled,
            missing=self.missing,
            unmatched=self.unmatched,
        )

    def report(self) -> DetectReport:
        return DetectReport(self.exceptions, self.choices_needed, self.missing, self.unmatched)


def merge_tables(
    spark: SparkSession,
    template_headers: DataFrame,
    headers: DataFrame,
    rows: DataFrame,
    decisions: DataFrame | None = None,
    policy: dict[str, str] | str | None = None,
    **kwargs,
) -> MergeResult:
    """Merge every source sheet into the template (pass 2 of the flow)."""
    return MergePlan(spark, template_headers, headers, rows, decisions, policy, **kwargs).result()


def detect_anomalies(
    spark: SparkSession,
    template_headers: DataFrame,
    headers: DataFrame,
    rows: DataFrame,
    decisions: DataFrame | None = None,
    **kwargs,
) -> DetectReport:
    """Pass 1: what would need a decision (fill ``decisions`` from this)."""
    return MergePlan(spark, template_headers, headers, rows, decisions, **kwargs).report()
