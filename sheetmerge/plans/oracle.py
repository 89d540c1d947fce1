"""DuckDB SQL for the derived fixtures and for every operator's result.

The SQL re-derives each result independently of the Spark code: values are
read by list index or from a long ``cells`` table, the duplicate rule is a
CASE over counts, and alignment is one LEFT JOIN per template slot. Only
the fixture description (``plans.fixtures``) is shared.
"""

from __future__ import annotations

from sheetmerge import model
from sheetmerge.operators.merge import physical_names
from sheetmerge.plans.fixtures import FIXTURES, Fixture, Part, Variant


def q(s: str | None) -> str:
    """SQL string literal."""
    if s is None:
        return "NULL"
    return "'" + str(s).replace("'", "''") + "'"


def ident(s: str) -> str:
    return '"' + s.replace('"', '""') + '"'


def _lst(items) -> str:
    return "list_value(" + ", ".join(items) + ")"


def _duck_vals(v: Variant) -> str:
    base = _lst(v.vals)
    if v.extra_when is None:
        return base
    return f"CASE WHEN {v.extra_when} THEN {_lst(v.vals + v.extra_vals)} ELSE {base} END"


def _duck_header(v: Variant) -> str:
    return "CAST(" + _lst("NULL" if n is None else q(n) for n in v.header) + " AS VARCHAR[])"


def _case(part: Part, pick) -> str:
    whens = " ".join(f"WHEN {k} THEN {pick(v)}" for k, v in sorted(part.variants.items()))
    return f"CASE {part.variant} {whens} END"


def _rows_sql(part: Part) -> str:
    if part.row_no is not None:
        row_no = f"CAST({part.row_no} AS BIGINT)"
    else:
        row_no = (
            f"CAST(row_number() OVER (PARTITION BY {', '.join(part.row_partition)} "
            f"ORDER BY {', '.join(part.row_order)}) AS BIGINT)"
        )
    return (
        f"SELECT CAST({part.file} AS VARCHAR) AS file, CAST({part.sheet} AS VARCHAR) AS sheet, "
        f"{row_no} AS row_no, {_case(part, _duck_vals)} AS vals FROM {part.table}"
    )


def _headers_sql(part: Part) -> str:
    return (
        "SELECT file, sheet, CAST(unnest(generate_series(0, len(h) - 1)) AS INTEGER) AS col_idx, "
        "unnest(h) AS name FROM (SELECT DISTINCT "
        f"CAST({part.file} AS VARCHAR) AS file, CAST({part.sheet} AS VARCHAR) AS sheet, "
        f"{_case(part, _duck_header)} AS h FROM {part.table})"
    )


def _template_sql(fx: Fixture) -> str:
    t = fx.template
    names = _lst(q(n) for n in t.names)
    if t.sheet_table:
        where = f" WHERE {t.sheet_filter}" if t.sheet_filter else ""
        sheets = f"(SELECT DISTINCT CAST({t.sheet_expr} AS VARCHAR) AS sheet FROM {t.sheet_table}{where})"
    else:
        sheets = "(SELECT * FROM (VALUES " + ", ".join(f"({q(s)})" for s in t.sheets) + ") v(sheet))"
    return (
        f"SELECT sheet, CAST(unnest(generate_series(0, {len(t.names) - 1})) AS INTEGER) AS t_idx, "
        f"unnest({names}) AS name FROM {sheets}"
    )


def _decisions_sql(fx: Fixture) -> str:
    cols = "file, sheet, kind, name, col_idx, t_occ, action, reason"
    typed = (
        "SELECT CAST(file AS VARCHAR) AS file, CAST(sheet AS VARCHAR) AS sheet, CAST(kind AS VARCHAR) AS kind, "
        "CAST(name AS VARCHAR) AS name, CAST(col_idx AS INTEGER) AS col_idx, CAST(t_occ AS INTEGER) AS t_occ, "
        "CAST(action AS VARCHAR) AS action, CAST(reason AS VARCHAR) AS reason FROM "
    )
    if not fx.decisions:
        return typed + f"(SELECT NULL AS file, NULL AS sheet, NULL AS kind, NULL AS name, NULL AS col_idx, NULL AS t_occ, NULL AS action, NULL AS reason) WHERE false"
    values = ", ".join(
        "(" + ", ".join("NULL" if x is None else (str(x) if isinstance(x, int) else q(x)) for x in d) + ")"
        for d in fx.decisions
    )
    return typed + f"(VALUES {values}) d({cols})"


def letters_sql(idx: str) -> str:
    """0-based index -> A, B, .. Z, AA .. in DuckDB SQL.

    There are 26^n names of n letters, so the first of them has the index
    26 + .. + 26^(n-1); the distance from it is a plain base-26 number of n
    digits.
    """
    starts = [sum(26**k for k in range(1, n)) for n in range(1, 9)]
    whens = []
    for n in range(1, 8):
        digits = " || ".join(f"chr(CAST(65 + ((CAST({idx} AS BIGINT) - {starts[n - 1]}) // {26**k}) % 26 AS INTEGER))" for k in reversed(range(n)))
        whens.append(f"WHEN {idx} >= {starts[n - 1]} AND {idx} < {starts[n]} THEN {digits}")
    return "CASE " + " ".join(whens) + " END"


def whole_result(fx: Fixture | str) -> str:
    """Every merged sheet and every audit table of a merge, one text line a row."""
    fx = FIXTURES[fx] if isinstance(fx, str) else fx

    def line(*cols: str) -> str:
        return " || '|' || ".join(f"coalesce({c}, '-')" for c in cols)

    slots = [f"c{k}" for k in range(1, max(len(fx.template.names), 1))]
    return (
        f"SELECT 'sheet' AS part, sheet, {line(ident(model.SOURCE_NAME_COLUMN), *slots)} AS line FROM merged "
        f"UNION ALL SELECT 'exceptions', sheet, {line('file', 'row_scope', 'col_name', 'col_pos', 'sample_values', 'kind', 'operation')} FROM exceptions "
        f"UNION ALL SELECT 'cancelled', '', {line('file', 'reason')} FROM cancelled "
        f"UNION ALL SELECT 'missing', sheet, {line('file', 'name')} FROM missing "
        f"UNION ALL SELECT 'unmatched', sheet, {line('file')} FROM unmatched"
    )


BLANK = "(name IS NULL OR name = '')"
NAMED = "(name IS NOT NULL AND name <> '')"

_POLICY = (
    "CASE kind "
    + " ".join(f"WHEN {q(k)} THEN {q(a)}" for k, a in model.DEFAULT_POLICY.items())
    + " END"
)


def derived_ctes(fx: Fixture) -> list[tuple[str, str]]:
    rows = " UNION ALL ".join(_rows_sql(p) for p in fx.parts)
    headers = " UNION ALL ".join(_headers_sql(p) for p in fx.parts)
    width = max(len(fx.template.names), 1)
    slot_joins = " ".join(
        f"LEFT JOIN assign a{k} ON a{k}.file = r.file AND a{k}.sheet = r.sheet AND a{k}.t_idx = {k}"
        for k in range(1, width)
    )
    slot_cols = ", ".join(f"r.vals[a{k}.col_idx + 1] AS c{k}" for k in range(1, width))
    return [
        ("fx_template", _template_sql(fx)),
        ("fx_headers", headers),
        ("fx_rows", rows),
        ("fx_decisions", _decisions_sql(fx)),
        ("tsheets", "SELECT DISTINCT sheet FROM fx_template"),
        (
            "tslots",
            "SELECT sheet, t_idx, name, "
            "CAST(row_number() OVER (PARTITION BY sheet, name ORDER BY t_idx) AS INTEGER) AS t_occ, "
            "CAST(count(*) OVER (PARTITION BY sheet, name) AS INTEGER) AS n_t "
            f"FROM fx_template WHERE t_idx >= 1 AND {NAMED}",
        ),
        ("tnames", f"SELECT DISTINCT sheet, name FROM fx_template WHERE {NAMED}"),
        ("fs", "SELECT DISTINCT file, sheet FROM fx_headers"),
        ("matched", "SELECT file, sheet FROM fs WHERE sheet IN (SELECT sheet FROM tsheets)"),
        ("unmatched", "SELECT file, sheet FROM fs WHERE sheet NOT IN (SELECT sheet FROM tsheets)"),
        (
            "width",
            "SELECT file, sheet, CAST(coalesce(max(CASE WHEN name IS NOT NULL AND name <> '' "
            "THEN col_idx END) + 1, 0) AS INTEGER) AS width FROM fx_headers GROUP BY file, sheet",
        ),
        (
            "occ",
            "SELECT file, sheet, col_idx, name, "
            "CAST(row_number() OVER (PARTITION BY file, sheet, name ORDER BY col_idx) AS INTEGER) AS occ, "
            "CAST(count(*) OVER (PARTITION BY file, sheet, name) AS INTEGER) AS n_s "
            f"FROM fx_headers WHERE {NAMED}",
        ),
        (
            "counts",
            "SELECT o.file, o.sheet, o.name, max(o.n_s) AS n_s, max(t.n_t) AS n_t FROM occ o "
            "JOIN tslots t ON t.sheet = o.sheet AND t.name = o.name GROUP BY o.file, o.sheet, o.name",
        ),
        (
            "dupvals",
            "SELECT r.file, r.sheet, o.name, r.row_no, r.vals[o.col_idx + 1] AS v FROM fx_rows r "
            "JOIN occ o ON o.file = r.file AND o.sheet = r.sheet "
            "JOIN counts k ON k.file = o.file AND k.sheet = o.sheet AND k.name = o.name WHERE k.n_s >= 2",
        ),
        (
            "roweq",
            "SELECT file, sheet, name, row_no, "
            "(count(DISTINCT v) = 0 OR (count(DISTINCT v) = 1 AND count(v) = count(*))) AS e "
            "FROM dupvals GROUP BY file, sheet, name, row_no",
        ),
        ("eqs", "SELECT file, sheet, name, bool_and(e) AS eq FROM roweq GROUP BY file, sheet, name"),
        (
            "rules",
            "SELECT k.file, k.sheet, k.name, k.n_s, k.n_t, coalesce(e.eq, true) AS eq, "
            "CASE WHEN k.n_s = 1 OR coalesce(e.eq, true) THEN 'fill_all' "
            "WHEN k.n_s = k.n_t THEN 'in_order' WHEN k.n_s > k.n_t THEN 'choose' "
            "ELSE 'in_order_short' END AS rule "
            "FROM counts k LEFT JOIN eqs e ON e.file = k.file AND e.sheet = k.sheet AND e.name = k.name",
        ),
        (
            "choices",
            "SELECT d.file, d.sheet, d.name, d.t_occ, min(d.col_idx) AS col_idx FROM fx_decisions d "
            "JOIN occ o ON o.file = d.file AND o.sheet = d.sheet AND o.name = d.name AND o.col_idx = d.col_idx "
            "WHERE d.action = 'select' AND d.t_occ IS NOT NULL GROUP BY d.file, d.sheet, d.name, d.t_occ",
        ),
        (
            "positions",
            "SELECT t.sheet, t.t_idx, t.name, s.t_occ FROM fx_template t "
            "LEFT JOIN tslots s ON s.sheet = t.sheet AND s.t_idx = t.t_idx",
        ),
        (
            "assign",
            "SELECT m.file, m.sheet, p.t_idx, p.name, p.t_occ, r.rule, "
            "CASE WHEN r.rule = 'choose' THEN c.col_idx WHEN r.rule = 'fill_all' THEN o1.col_idx "
            "WHEN r.rule IN ('in_order', 'in_order_short') THEN ok.col_idx END AS col_idx "
            "FROM matched m JOIN positions p ON p.sheet = m.sheet "
            "LEFT JOIN rules r ON r.file = m.file AND r.sheet = m.sheet AND r.name = p.name "
            "LEFT JOIN occ o1 ON o1.file = m.file AND o1.sheet = m.sheet AND o1.name = p.name AND o1.occ = 1 "
            "LEFT JOIN occ ok ON ok.file = m.file AND ok.sheet = m.sheet AND ok.name = p.name AND ok.occ = p.t_occ "
            "LEFT JOIN choices c ON c.file = m.file AND c.sheet = m.sheet AND c.name = p.name AND c.t_occ = p.t_occ",
        ),
        (
            "unselected",
            "SELECT o.file, o.sheet, o.col_idx, o.name FROM occ o "
            "JOIN rules r ON r.file = o.file AND r.sheet = o.sheet AND r.name = o.name "
            "WHERE r.rule = 'choose' AND NOT EXISTS (SELECT 1 FROM assign a WHERE a.file = o.file "
            "AND a.sheet = o.sheet AND a.col_idx = o.col_idx)",
        ),
        (
            "cancelled",
            "SELECT file, min(coalesce(reason, kind)) AS reason FROM fx_decisions "
            "WHERE action = 'cancel_file' AND file IN (SELECT file FROM fx_headers) GROUP BY file",
        ),
        (
            "cells",
            "SELECT file, sheet, row_no, unnest(vals) AS v, "
            "CAST(unnest(generate_series(0, len(vals) - 1)) AS INTEGER) AS col_idx FROM fx_rows",
        ),
        (
            "blank",
            "SELECT h.file, h.sheet, h.col_idx FROM fx_headers h "
            "JOIN width w ON w.file = h.file AND w.sheet = h.sheet "
            "WHERE (h.name IS NULL OR h.name = '') AND h.col_idx < w.width",
        ),
        (
            "extra",
            "SELECT h.file, h.sheet, h.col_idx, h.name FROM fx_headers h "
            "WHERE h.name IS NOT NULL AND h.name <> '' AND h.sheet IN (SELECT sheet FROM tsheets) "
            "AND NOT EXISTS (SELECT 1 FROM tnames t WHERE t.sheet = h.sheet AND t.name = h.name)",
        ),
        (
            "overflow",
            "SELECT DISTINCT c.file, c.sheet, c.col_idx FROM cells c "
            "JOIN width w ON w.file = c.file AND w.sheet = c.sheet "
            "JOIN matched m ON m.file = c.file AND m.sheet = c.sheet "
            "WHERE c.col_idx >= w.width AND c.v IS NOT NULL",
        ),
        (
            "missing",
            "SELECT m.file, m.sheet, t.name FROM matched m "
            "JOIN (SELECT DISTINCT sheet, name FROM tslots) t ON t.sheet = m.sheet "
            "WHERE NOT EXISTS (SELECT 1 FROM fx_headers h WHERE h.file = m.file AND h.sheet = m.sheet "
            "AND h.name = t.name)",
        ),
        (
            "anomalies",
            f"SELECT b.file, b.sheet, {q(model.KIND_BLANK)} AS kind, b.col_idx, CAST(NULL AS VARCHAR) AS name "
            "FROM blank b JOIN matched m ON m.file = b.file AND m.sheet = b.sheet "
            f"UNION ALL SELECT file, sheet, {q(model.KIND_OVERFLOW)}, col_idx, NULL FROM overflow "
            f"UNION ALL SELECT file, sheet, {q(model.KIND_EXTRA)}, col_idx, name FROM extra "
            f"UNION ALL SELECT file, sheet, {q(model.KIND_UNSELECTED)}, col_idx, name FROM unselected",
        ),
        (
            "adec",
            "SELECT file, sheet, kind, col_idx, CASE WHEN bool_or(action = 'cancel_file') THEN 'cancel_file' "
            "ELSE min(action) END AS action FROM fx_decisions WHERE action <> 'select' AND col_idx IS NOT NULL "
            "GROUP BY file, sheet, kind, col_idx",
        ),
        (
            "ops",
            f"SELECT a.file, a.sheet, a.kind, a.col_idx, a.name, coalesce(d.action, {_POLICY.replace('kind', 'a.kind')}) AS action, "
            f"CASE WHEN a.file IN (SELECT file FROM cancelled) THEN 'cancel_file' "
            f"ELSE coalesce(d.action, {_POLICY.replace('kind', 'a.kind')}) END AS operation "
            "FROM anomalies a LEFT JOIN adec d ON d.file = a.file AND d.sheet = a.sheet AND d.kind = a.kind "
            "AND d.col_idx = a.col_idx",
        ),
        (
            "samples",
            "SELECT a.file, a.sheet, a.col_idx, string_agg(r.vals[a.col_idx + 1], ',' ORDER BY r.row_no) AS sample "
            "FROM (SELECT DISTINCT file, sheet, col_idx FROM anomalies) a "
            "JOIN fx_rows r ON r.file = a.file AND r.sheet = a.sheet AND r.row_no <= 5 "
            "GROUP BY a.file, a.sheet, a.col_idx",
        ),
        (
            "exceptions",
            "SELECT o.file, o.sheet, "
            f"CASE WHEN o.kind IN ({q(model.KIND_BLANK)}, {q(model.KIND_OVERFLOW)}) THEN {q(model.SCOPE_ALL_ROWS)} "
            f"ELSE {q(model.SCOPE_NONE)} END AS row_scope, "
            f"CASE WHEN o.kind = {q(model.KIND_BLANK)} THEN {q(model.BLANK_COL_NAME)} "
            f"WHEN o.kind = {q(model.KIND_OVERFLOW)} THEN {q(model.SCOPE_NONE)} ELSE o.name END AS col_name, "
            f"{letters_sql('o.col_idx')} AS col_pos, coalesce(s.sample, '') AS sample_values, o.kind, o.operation "
            "FROM ops o LEFT JOIN samples s ON s.file = o.file AND s.sheet = o.sheet AND s.col_idx = o.col_idx",
        ),
        (
            "merged",
            f"SELECT r.sheet, r.file, r.row_no, r.file AS {ident(model.SOURCE_NAME_COLUMN)}, {slot_cols} "
            "FROM fx_rows r JOIN matched m ON m.file = r.file AND m.sheet = r.sheet "
            f"{slot_joins} WHERE r.file NOT IN (SELECT file FROM cancelled)",
        ),
    ]


def with_fixture(fx: Fixture | str, final: str) -> str:
    fx = FIXTURES[fx] if isinstance(fx, str) else fx
    ctes = ",\n".join(f"{name} AS ({body})" for name, body in derived_ctes(fx))
    return f"WITH {ctes}\n{final}"


def sheet_select(fx: Fixture | str, sheet: str | None) -> str:
    """Final SELECT of merged rows under a sheet's physical column names."""
    fx = FIXTURES[fx] if isinstance(fx, str) else fx
    names = physical_names(list(fx.template.names))
    cols = [ident(names[0])] + [f"c{k} AS {ident(n)}" for k, n in enumerate(names) if k > 0]
    where = f" WHERE sheet = {q(sheet)}" if sheet is not None else ""
    lead = "sheet, " if sheet is None else ""
    return f"SELECT {lead}{', '.join(cols)} FROM merged{where}"
