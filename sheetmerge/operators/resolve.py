"""Duplicate-name resolution (#19-#23) and the column map (#26).

For a source sheet and a name with ``n_s`` source columns and ``n_t``
template slots (slot 0 aside):

* n_s = 1, or all n_s columns equal on every row  -> every slot takes the
  first column                                     (step 1, 'fill_all')
* n_s = n_t                                        -> slot k takes column k
                                                      (step 2, 'in_order')
* n_s > n_t                                        -> slot k takes the column
  the user chose for it, or stays empty             (step 3, 'choose')
* 2 <= n_s < n_t, differing                        -> first n_s slots in
  order, the rest empty                             ('in_order_short')

All inputs here are header-sized; nothing touches ``rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetmerge.model import (
    RULE_CHOOSE,
    RULE_FILL_ALL,
    RULE_IN_ORDER,
    RULE_IN_ORDER_SHORT,
    SELECT,
)
from sheetmerge.operators.detect import dup_equality
from sheetmerge.operators.match import match_sheets
from sheetmerge.operators.template import template_slots
from sheetmerge.plans.sizing import template_side


def dup_consistency(counts: DataFrame, facts: DataFrame) -> DataFrame:
    """Step 1 test for each duplicated template name.

    -> (file, sheet, name, n_s, eq); a sheet without data rows counts as equal.
    """
    return (
        counts.where(F.col("n_s") >= 2)
        .join(dup_equality(facts), ["file", "sheet", "name"], "left")
        .select("file", "sheet", "name", "n_s", F.coalesce("eq", F.lit(True)).alias("eq"))
    )


def dup_rule(counts: DataFrame, facts: DataFrame) -> DataFrame:
    """Which step applies to every (source sheet, name) on both sides.

    -> (file, sheet, name, n_s, n_t, eq, rule)
    """
    eq = dup_consistency(counts, facts).select("file", "sheet", "name", "eq")
    joined = counts.join(eq, ["file", "sheet", "name"], "left")
    eq_col = F.coalesce(F.col("eq"), F.lit(True))
    rule = (
        F.when((F.col("n_s") == 1) | eq_col, F.lit(RULE_FILL_ALL))
        .when(F.col("n_s") == F.col("n_t"), F.lit(RULE_IN_ORDER))
        .when(F.col("n_s") > F.col("n_t"), F.lit(RULE_CHOOSE))
        .otherwise(F.lit(RULE_IN_ORDER_SHORT))
    )
    return joined.select("file", "sheet", "name", "n_s", "n_t", eq_col.alias("eq"), rule.alias("rule"))


def valid_choices(occurrence: DataFrame, decisions: DataFrame) -> DataFrame:
    """User choices for step 3 that point at a column of that very name.

    -> (file, sheet, name, t_occ, col_idx); one per slot (lowest col_idx wins).
    """
    picks = decisions.where(
        (F.col("action") == SELECT) & F.col("t_occ").isNotNull() & F.col("col_idx").isNotNull()
    ).select("file", "sheet", "name", "col_idx", "t_occ")
    return (
        picks.join(occurrence.select("file", "sheet", "name", "col_idx"), ["file", "sheet", "name", "col_idx"], "left_semi")
        .groupBy("file", "sheet", "name", "t_occ")
        .agg(F.min("col_idx").alias("col_idx"))
    )


def slot_assignment(
    headers: DataFrame,
    template_headers: DataFrame,
    occurrence: DataFrame,
    rules: DataFrame,
    choices: DataFrame,
    matched: DataFrame | None = None,
) -> DataFrame:
    """Source column feeding every template position of every matched sheet.

    ``matched`` = (file, sheet) of the matched source sheets, when already known.

    -> (file, sheet, t_idx, name, t_occ, rule, col_idx); all template positions
    appear (slot 0 and unnamed slots with null), col_idx null = empty slot.
    """
    slots = template_slots(template_headers).select("sheet", "t_idx", "t_occ")
    positions = template_headers.select("sheet", "t_idx", "name").join(
        template_side(slots), ["sheet", "t_idx"], "left"
    )
    if matched is None:
        matched = match_sheets(headers, template_headers)
    grid = matched.select("file", "sheet").join(template_side(positions), "sheet")
    with_rule = grid.join(rules.select("file", "sheet", "name", "n_s", "rule"), ["file", "sheet", "name"], "left")
    want_occ = (
        F.when(F.col("rule") == RULE_FILL_ALL, F.lit(1))
        .when(F.col("rule").isin(RULE_IN_ORDER, RULE_IN_ORDER_SHORT), F.col("t_occ"))
    )
    by_occ = occurrence.select(
        "file", "sheet", "name", F.col("occ").alias("want_occ"), F.col("col_idx").alias("occ_col")
    )
    by_choice = choices.select(
        "file", "sheet", "name", "t_occ", F.col("col_idx").alias("chosen_col")
    )
    return (
        with_rule.withColumn("want_occ", want_occ)
        .join(by_occ, ["file", "sheet", "name", "want_occ"], "left")
        .join(by_choice, ["file", "sheet", "name", "t_occ"], "left")
        .select(
            "file",
            "sheet",
            "t_idx",
            "name",
            "t_occ",
            "rule",
            F.when(F.col("rule") == RULE_CHOOSE, F.col("chosen_col"))
            .otherwise(F.col("occ_col"))
            .alias("col_idx"),
        )
    )


def dup_in_order(assignment: DataFrame) -> DataFrame:
    """Step 2 pairs. -> (file, sheet, name, t_idx, t_occ, col_idx)"""
    return assignment.where(F.col("rule") == RULE_IN_ORDER).select(
        "file", "sheet", "name", "t_idx", "t_occ", "col_idx"
    )


def dup_by_choice(assignment: DataFrame) -> DataFrame:
    """Step 3 slots and their chosen column (null = no choice given).

    -> (file, sheet, name, t_idx, t_occ, col_idx)
    """
    return assignment.where(F.col("rule") == RULE_CHOOSE).select(
        "file", "sheet", "name", "t_idx", "t_occ", "col_idx"
    )


def unselected_columns(occurrence: DataFrame, rules: DataFrame, assignment: DataFrame) -> DataFrame:
    """Source columns of a step-3 name that no slot took. -> (file, sheet, col_idx, name)

    ``assignment`` may be any (file, sheet, col_idx) table of used columns.
    """
    used = assignment.where(F.col("col_idx").isNotNull()).select("file", "sheet", "col_idx")
    return (
        occurrence.join(
            rules.where(F.col("rule") == RULE_CHOOSE).select("file", "sheet", "name"),
            ["file", "sheet", "name"],
            "left_semi",
        )
        .join(used, ["file", "sheet", "col_idx"], "left_anti")
        .select("file", "sheet", "col_idx", "name")
    )


def used_columns(mapping: DataFrame) -> DataFrame:
    """(file, sheet, col_idx) of every source column some slot takes."""
    return mapping.select("file", "sheet", F.explode("m").alias("col_idx")).where(F.col("col_idx").isNotNull())


def build_mapping(assignment: DataFrame, cancelled: DataFrame | None = None) -> DataFrame:
    """Fold the assignment into one index array per source sheet.

    -> (file, sheet, m array<int>) with m[t_idx] = source column or null.
    A group is one sheet's template width (bounded by the template).
    """
    src = assignment
    if cancelled is not None:
        src = src.join(cancelled.select("file"), "file", "left_anti")
    ordered = F.array_sort(F.collect_list(F.struct("t_idx", "col_idx")))
    return src.groupBy("file", "sheet").agg(
        F.transform(ordered, lambda s: s["col_idx"]).alias("m")
    )


def _dense(pairs: Column, width: Column) -> Column:
    """(place, value) pairs as an array of ``width`` entries, null where there is no pair.

    Sorted in among a blank for every place, each place's last entry is its
    pair, or the blank: no lookup per place.
    """
    blanks = F.transform(F.sequence(F.lit(0), width - 1), lambda k: F.struct(k.alias("t_idx"), F.lit(None).cast("int").alias("col_idx")))

    def last_of_each(sorted_: Column) -> Column:
        kept = F.filter(sorted_, lambda x, k: F.coalesce(F.get(sorted_, k + 1)["t_idx"] != x["t_idx"], F.lit(True)))
        return F.transform(kept, lambda x: x["col_idx"])

    # bound as a lambda variable the array is sorted once, not once for every entry
    return F.get(F.transform(F.array(F.array_sort(F.concat(pairs, blanks))), last_of_each), F.lit(0))


def column_map(
    occurrence: DataFrame, template_headers: DataFrame, rules: DataFrame, choices: DataFrame, matched: DataFrame
) -> DataFrame:
    """The index array of every matched sheet, as :func:`build_mapping` of :func:`slot_assignment`. -> (file, sheet, m)

    Source columns meet the slots of their name (a broadcast of the
    template); nothing is laid out for the slots that stay empty. A name
    that a sheet has once needs no rule: it fills all its slots. Rules and
    choices are joined for the repeated names alone, and one aggregate a
    sheet gathers what its template's slots take.
    """
    slots = template_side(template_slots(template_headers).select("sheet", "name", "t_idx", "t_occ"))
    widths = template_headers.groupBy("sheet").agg((F.max("t_idx") + 1).alias("width"))
    pair = ["file", "sheet", "t_idx", "col_idx"]
    filled = occurrence.where(F.col("n_s") == 1).join(slots, ["sheet", "name"]).select(*pair)
    repeated = occurrence.where(F.col("n_s") >= 2).join(rules.select("file", "sheet", "name", "rule"), ["file", "sheet", "name"])
    repeated = repeated.join(slots, ["sheet", "name"])
    rule, occ = F.col("rule"), F.col("occ")
    by_rule = repeated.where(
        ((rule == RULE_FILL_ALL) & (occ == 1)) | (rule.isin(RULE_IN_ORDER, RULE_IN_ORDER_SHORT) & (occ == F.col("t_occ")))
    ).select(*pair)
    chosen = choices.select("file", "sheet", "name", "t_occ", "col_idx")
    by_choice = repeated.where(rule == RULE_CHOOSE).join(chosen, ["file", "sheet", "name", "t_occ", "col_idx"], "left_semi").select(*pair)
    none = matched.select("file", "sheet", F.lit(None).cast("int").alias("t_idx"), F.lit(None).cast("int").alias("col_idx"))
    taken = F.when(F.col("t_idx").isNotNull(), F.struct("t_idx", "col_idx"))
    sheets = filled.unionByName(by_rule).unionByName(by_choice).unionByName(none).groupBy("file", "sheet").agg(F.collect_list(taken).alias("pairs"))
    return sheets.join(template_side(widths), "sheet").select("file", "sheet", _dense(F.col("pairs"), F.col("width")).alias("m"))
