"""Small helpers that spell the oracle SQL (DuckDB dialect) for the catalog.

These strings are only the *reference* side of the correctness check; the
engine itself never parses or plans SQL.
"""

from __future__ import annotations

from panelcast.functions.calendar import FIXED_HOLIDAYS, JUNETEENTH, WEEKDAY_HOLIDAYS


def rnd(expr: str, digits: int) -> str:
    """Two-step decimal rounding, the same as ``functions.numeric.round_dec``:
    first to 9 decimals (absorbs last-bit differences from summation order),
    then HALF_UP to ``digits`` on the decimal value, so exact halves such as
    0.0399315 round the same way in both engines."""
    return (f"(CAST(ROUND(ROUND(CAST(CAST({expr} AS DOUBLE) AS DECIMAL(38, 17)), 9), {digits}) AS DOUBLE)"
            f" + 0.0)")


def r6(expr: str) -> str:
    return rnd(expr, 6)


def r2(expr: str) -> str:
    return rnd(expr, 2)


def _fixed_on(d: str) -> str:
    parts = [f"(month({d}) = {m} AND day({d}) = {dd})" for m, dd in FIXED_HOLIDAYS]
    jm, jd, jy = JUNETEENTH
    parts.append(f"(month({d}) = {jm} AND day({d}) = {jd} AND year({d}) >= {jy})")
    return "(" + " OR ".join(parts) + ")"


def holiday_sql(d: str = "date") -> str:
    wd = f"(isodow({d}) - 1)"
    parts = [_fixed_on(d)]
    for m, w, lo, hi in WEEKDAY_HOLIDAYS:
        parts.append(f"(month({d}) = {m} AND {wd} = {w} AND day({d}) BETWEEN {lo} AND {hi})")
    parts.append(f"({wd} = 4 AND {_fixed_on(f'CAST({d} + INTERVAL 1 DAY AS DATE)')})")
    parts.append(f"({wd} = 0 AND {_fixed_on(f'CAST({d} - INTERVAL 1 DAY AS DATE)')})")
    return "CAST((" + " OR ".join(parts) + ") AS INTEGER)"


def date_features_sql(d: str = "date", cyclical: bool = True, holidays: bool = True) -> str:
    cols = [
        f"CAST(year({d}) AS INTEGER) AS year",
        f"CAST(month({d}) AS INTEGER) AS month",
        f"CAST(day({d}) AS INTEGER) AS day",
        f"CAST(isodow({d}) - 1 AS INTEGER) AS dayofweek",
        f"CAST(dayofyear({d}) AS INTEGER) AS dayofyear",
        f"CAST(weekofyear({d}) AS INTEGER) AS weekofyear",
        f"CAST(quarter({d}) AS INTEGER) AS quarter",
        f"CAST({d} = last_day({d}) AS INTEGER) AS is_month_end",
        f"CAST({d} = last_day({d}) AND month({d}) % 3 = 0 AS INTEGER) AS is_quarter_end",
    ]
    if cyclical:
        cols += [
            f"{r6(f'sin(2 * pi() * month({d}) / 12)')} AS month_sin",
            f"{r6(f'cos(2 * pi() * month({d}) / 12)')} AS month_cos",
            f"{r6(f'sin(2 * pi() * (isodow({d}) - 1) / 7)')} AS dow_sin",
            f"{r6(f'cos(2 * pi() * (isodow({d}) - 1) / 7)')} AS dow_cos",
        ]
    if holidays:
        cols.append(f"{holiday_sql(d)} AS is_holiday")
    return ",\n  ".join(cols)


def shifted_roll_sql(value: str, n: int, agg: str, part: str, order: str) -> str:
    frame = f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    fn = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "sum": "sum",
          "var": "var_samp"}[agg]
    minp = max(1, n // 2)
    inner = f"{fn}({value}) OVER {frame}"
    if agg in ("std", "var"):
        inner = f"CASE WHEN count({value}) OVER {frame} >= 2 THEN {inner} END"
    return f"CASE WHEN count({value}) OVER {frame} >= {minp} THEN {r6(inner)} END"


def trailing_roll_sql(value: str, n: int, agg: str, part: str, order: str) -> str:
    frame = f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    if agg == "median":
        inner = f"quantile_cont({value}, 0.5) OVER {frame}"
    elif agg == "skew":
        inner = (f"CASE WHEN var_pop({value}) OVER {frame} = 0 THEN 0.0 "
                 f"ELSE skewness({value}) OVER {frame} END")
    else:
        fn = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "sum": "sum"}[agg]
        inner = f"{fn}({value}) OVER {frame}"
    return f"CASE WHEN count({value}) OVER {frame} >= {n} THEN {r6(inner)} END"


def _poly_sql(coefs, r: str) -> str:
    acc = repr(float(coefs[-1]))
    for c in reversed(coefs[:-1]):
        acc = f"({acc} * {r} + {float(c)!r})"
    return acc


def norm_ppf_sql(p: str) -> str:
    """Inverse standard normal CDF (AS 241, same coefficients as
    ``functions.normal``) spelled in SQL; ``p`` must be a column/alias."""
    from panelcast.functions.normal import A, B, C, D, E, Fc

    q = f"({p} - 0.5)"
    r1 = f"(0.180625 - {q} * {q})"
    central = f"({q} * {_poly_sql(A, r1)} / {_poly_sql(B, r1)})"
    rt = f"SQRT(-LN(CASE WHEN {q} < 0 THEN {p} ELSE 1 - {p} END))"
    tail = (f"(CASE WHEN {rt} <= 5 THEN {_poly_sql(C, f'({rt} - 1.6)')} / {_poly_sql(D, f'({rt} - 1.6)')} "
            f"ELSE {_poly_sql(E, f'({rt} - 5)')} / {_poly_sql(Fc, f'({rt} - 5)')} END)")
    return (f"(CASE WHEN {p} IS NULL OR {p} <= 0 OR {p} >= 1 THEN NULL "
            f"WHEN ABS({q}) <= 0.425 THEN {central} "
            f"WHEN {q} < 0 THEN -{tail} ELSE {tail} END)")


def norm_sf_sql(z: str) -> str:
    """Upper normal tail 0.5 * erfc(z / sqrt 2) with the same erfc fit."""
    from panelcast.functions.normal import ERFC

    x = f"(({z}) / SQRT(2.0))"
    t = f"(1.0 / (1.0 + 0.5 * ABS({x})))"
    ans = f"({t} * EXP(-ABS({x}) * ABS({x}) + {_poly_sql(ERFC, t)}))"
    return f"(0.5 * CASE WHEN {x} >= 0 THEN {ans} ELSE 2.0 - {ans} END)"
