"""One autoregression per series in closed form, as Spark expressions.

A least-squares fit on the last two weeks, and on one seasonal lag where that is better, needs only sums of products of lagged values. They
come from one window and one aggregate per series. All seasonal candidates share the products of the base lags: each adds one row to the
factorised base, so comparing them costs one more pivot, not another fit. Values enter as whole thousandths of log1p, so sums are exact.

Stages are written as SQL text on the names of the stage before: Spark runs them as select lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.operators.marts import SKU

BASE = ("1000", "p1", "p2")  # the constant and the last two weeks
LEAST_WEEKS = 6  # longer histories are fitted
TWO_YEARS = 104  # a season of a year needs them
SINGULAR = 1e-9  # a pivot below this share of its diagonal carries no information of its own
DIVERGED = 20.723  # log1p of a milliard: forecasts beyond count as not finite
WINDOW = "over (partition by center_id, sku_id order by week_st)"
WHOLE = "over (partition by center_id, sku_id)"

Stage = dict[str, str]


def _product(a: str, b: str, rows: str) -> str:
    return f"sum(case when {rows} then cast({a} as bigint) * {b} end)"


def lag_stages(cutoff: str, seasons: tuple[int, ...], steps: int) -> list[Stage]:
    """Row stages: value, position, lags, and the seasonal values that the forecasts of each step need."""
    lags = {f"p{k}": f"lag(v, {k}) {WINDOW}" for k in (1, 2)} | {f"q{s}": f"lag(v, {s}) {WINDOW}" for s in seasons}
    ahead = {f"q{s}_{h}": f"lag(v, {s - h}) {WINDOW}" for s in seasons for h in range(1, steps + 1)}
    start = " ".join(f"when n_known > {s + 5} and n_known >= {TWO_YEARS if s >= 52 else 0} then {s}" for s in sorted(seasons, reverse=True))
    return [
        {"v": "cast(floor(ln(1 + greatest(qty, 0)) * 1000 + 0.5) as bigint)", "known": f"week_st < date '{cutoff}'"},
        {"pos": f"row_number() {WINDOW}", "n_known": f"sum(case when known then 1 else 0 end) {WHOLE}", **lags, **ahead},
        {"first_row": f"case {start} else 2 end" if seasons else "2"},
    ]


def sum_stage(seasons: tuple[int, ...]) -> Stage:
    """Aggregates per series: sums over the rows common to all candidates (c_), and over all rows of each candidate (r0_, r13_, ...)."""
    out = {"n_known": "max(n_known)", "first_row": "max(first_row)", "low": "min(case when known then qty end)", "high": "max(case when known then qty end)", "mean_qty": "avg(case when known then cast(qty as double) end)"}
    common = "known and pos > first_row"
    for i, a in enumerate(BASE):
        out |= {f"c_{i}{j}": _product(a, b, common) for j, b in enumerate(BASE) if j <= i} | {f"c_y{i}": _product(a, "v", common)}
    out["c_yy"] = _product("v", "v", common)
    for s in seasons:
        out |= {f"c{s}_3{j}": _product(f"q{s}", b, common) for j, b in enumerate((*BASE, f"q{s}"))} | {f"c{s}_y3": _product(f"q{s}", "v", common)}
    for s in (0, *seasons):
        use = BASE if not s else (*BASE, f"q{s}")
        for i, a in enumerate(use):
            out |= {f"r{s}_{i}{j}": _product(a, b, f"known and pos > {max(2, s)}") for j, b in enumerate(use) if j <= i} | {f"r{s}_y{i}": _product(a, "v", f"known and pos > {max(2, s)}")}
    return out


def _unit(name: str) -> str:
    return f"cast({name} as double) / 1e6"


def _pivot(raw: str, diagonal: str) -> str:
    """Null where a column adds nothing to those before it, and so everything that follows from it."""
    return f"case when {raw} > {SINGULAR} * ({diagonal}) then {raw} end"


def choice_stages(seasons: tuple[int, ...]) -> list[Stage]:
    """Criterion (corrected information criterion) of the base and of each season on the common rows, and the season of lowest criterion."""
    steps: list[Stage] = []
    a = lambda i, j: _unit(f"c_{i}{j}")
    for i in range(3):
        for j in range(i):
            steps.append({f"x{i}{j}": "(" + " - ".join([a(i, j), *[f"x{i}{k} * x{j}{k} * d{k}" for k in range(j)]]) + f") / d{j}"})
        raw = " - ".join([a(i, i), *[f"x{i}{k} * x{i}{k} * d{k}" for k in range(i)]])
        steps.append({f"d{i}": _pivot(raw, a(i, i)), f"z{i}": " - ".join([_unit(f"c_y{i}"), *[f"x{i}{k} * z{k}" for k in range(i)]])})
    steps.append({"rss0": f"{_unit('c_yy')} - z0 * z0 / d0 - z1 * z1 / d1 - z2 * z2 / d2", "n_rows": "cast(n_known - first_row as double)"})
    for j in range(3):
        steps.append({f"x{s}_3{j}": "(" + " - ".join([_unit(f"c{s}_3{j}"), *[f"x{s}_3{k} * x{j}{k} * d{k}" for k in range(j)]]) + f") / d{j}" for s in seasons})
    steps.append({f"d{s}_3": _pivot(" - ".join([_unit(f"c{s}_33"), *[f"x{s}_3{k} * x{s}_3{k} * d{k}" for k in range(3)]]), _unit(f"c{s}_33")) for s in seasons}
                 | {f"z{s}_3": " - ".join([_unit(f"c{s}_y3"), *[f"x{s}_3{k} * z{k}" for k in range(3)]]) for s in seasons})
    steps.append({f"rss{s}": f"rss0 - z{s}_3 * z{s}_3 / d{s}_3" for s in seasons})

    def criterion(s: int) -> str:
        p = 4 if s == 0 else 5
        value = f"n_rows * ln(greatest(rss{s}, 1e-12) / n_rows) + {2 * p} + {2 * p * (p + 1)} / (n_rows - {p + 1})"
        return f"case when rss{s} is not null and n_rows > {p + 1}{f' and first_row >= {s}' if s else ''} then {value} end"

    steps.append({f"ic{s}": criterion(s) for s in (0, *seasons)})
    if seasons:
        steps.append({"lowest": f"least({', '.join(f'ic{s}' for s in (0, *seasons))})"})
        steps.append({"season": "case " + " ".join(f"when ic{s} = lowest then {s}" for s in (0, *sorted(seasons))) + " else 0 end"})
    else:
        steps.append({"season": "0"})
    return [s for s in steps if s]


def fit_stages(seasons: tuple[int, ...]) -> list[Stage]:
    """Coefficients w0 to w3 of the chosen candidate on all its rows, and the status of the series."""
    pick = lambda name, base: "case season " + " ".join(f"when {s} then {_unit(f'r{s}_{name}')}" for s in (0, *seasons) if s or not base) + (f" else {base} end" if base else " end")
    entries = {f"m{i}{j}": pick(f"{i}{j}", "" if i < 3 else ("1e0" if j == 3 else "0e0")) for i in range(4) for j in range(i + 1)} | {f"b{i}": pick(f"y{i}", "" if i < 3 else "0e0") for i in range(4)}
    if not seasons:
        entries |= {f"m3{j}": "0e0" for j in range(3)} | {"m33": "1e0", "b3": "0e0"}
    steps: list[Stage] = [entries]
    for i in range(4):
        for j in range(i):
            steps.append({f"y{i}{j}": "(" + " - ".join([f"m{i}{j}", *[f"y{i}{k} * y{j}{k} * e{k}" for k in range(j)]]) + f") / e{j}"})
        raw = " - ".join([f"m{i}{i}", *[f"y{i}{k} * y{i}{k} * e{k}" for k in range(i)]])
        steps.append({f"e{i}": _pivot(raw, f"m{i}{i}"), f"u{i}": " - ".join([f"b{i}", *[f"y{i}{k} * u{k}" for k in range(i)]])})
    for i in reversed(range(4)):
        steps.append({f"w{i}": " - ".join([f"u{i} / e{i}", *[f"y{k}{i} * w{k}" for k in range(i + 1, 4)]])})
    steps.append({"status": f"case when low = high then 'constant history' when n_known <= {LEAST_WEEKS} then 'history too short' when w0 is null then 'singular history' else 'fitted' end"})
    return steps


def path_stages(seasons: tuple[int, ...], steps: int) -> list[Stage]:
    """Forecasts of log1p for 1 to ``steps`` weeks ahead, each on the ones before it, and quantities (raw1, raw2, ...)."""
    out: list[Stage] = []
    season = lambda h: "case season " + " ".join(f"when {s} then q{s}_{h} / 1e3" for s in seasons) + " else 0e0 end" if seasons else "0e0"
    back = lambda h, k: f"h{h - k}" if h > k else ("v / 1e3" if h == k else "p1 / 1e3")
    for h in range(1, steps + 1):
        out.append({f"h{h}": f"w0 + w1 * ({back(h, 1)}) + w2 * ({back(h, 2)}) + w3 * ({season(h)})"})
    whole = lambda x: f"floor(({x}) * 8192 + 0.5) / 8192"
    out.append({f"raw{h}": f"case when status = 'fitted' and pos >= greatest(2, season) then case when h{h} > {DIVERGED} then cast('infinity' as double) else {whole(f'exp(h{h}) - 1')} end else {whole('coalesce(mean_qty, 0e0)')} end"
                for h in range(1, steps + 1)})
    return out


def _apply(df: DataFrame, stages: list[Stage]) -> DataFrame:
    for stage in stages:
        df = df.selectExpr("*", *[f"{e} as {c}" for c, e in stage.items()])
    return df


def per_series_fit(df: DataFrame, cutoff: str, horizons, seasons: tuple[int, ...] = ()) -> DataFrame:
    """One autoregression per SKU on log1p, coefficients frozen at the cutoff, state moved week by week.

    With ``seasons`` each period is tried as an extra lag and the lowest criterion wins; all candidates are compared on the rows that the
    longest one leaves, the chosen one is fitted on all rows it has. A period is left out where its lag leaves too few rows, one of a year
    or more below two years. A series that is constant, too short or singular has its mean level and says why. ``y_raw`` is the forecast as
    it comes, infinite beyond a milliard; ``y_pred`` is the delivered one: not below zero, and zero where the raw one is not finite.

    No Python runs; lags, sums and the return of the coefficients share the partitioning by series, which the calendar bounds.
    """
    last = max(horizons)
    rows = _apply(df.select(*SKU, "week_st", "qty"), lag_stages(cutoff, seasons, last))
    sums = rows.groupBy(*SKU).agg(*[F.expr(e).alias(c) for c, e in sum_stage(seasons).items()])
    fits = _apply(sums, [*choice_stages(seasons), *fit_stages(seasons)]).select(*SKU, "status", "season", "mean_qty", "w0", "w1", "w2", "w3")
    ahead = _apply(rows.where("not known").drop("n_known", "first_row", *[f"q{s}" for s in seasons]).join(fits, SKU), path_stages(seasons, last))
    steps = F.array(*[F.struct(F.lit(h).alias("horizon"), F.date_add("week_st", 7 * h).alias("target_date"), F.col(f"raw{h}").alias("y_raw")) for h in horizons])
    out = ahead.select(*SKU, "week_st", "status", F.col("season").cast("int").alias("season"), F.explode(steps).alias("r"))
    delivered = F.when((F.col("r.y_raw") > 0) & (F.col("r.y_raw") < float("inf")), F.col("r.y_raw")).otherwise(0.0)
    return out.select(*SKU, "week_st", "r.horizon", "r.target_date", F.lit("ar_seasonal" if seasons else "ar").alias("model"), "status", "season", delivered.alias("y_pred"), "r.y_raw")
