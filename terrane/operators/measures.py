"""Statistics, ledgers, time and score operators that several layers share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], bins: int = 4096) -> DataFrame:
    """One row of exact quantiles {name: (column, q)} over whole tables, with linear interpolation.

    A percentile aggregate would hold all distinct values in one task. Here the ranks that a quantile lies between are
    closed in by counting passes over bins (each pass is a partial aggregate of at most bins rows for each quantile),
    until few values are left between; nulls and NaN do not count. Without values a quantile is null.
    """
    names = list(wanted)
    cols = {n: F.when(~F.isnan(F.col(wanted[n][0]).cast("double")), F.col(wanted[n][0]).cast("double")) for n in names}
    rows = df.select(*[cols[n].alias(n) for n in names])
    first = rows.agg(*[x for n in names for x in (F.count(n).alias(f"n_{n}"), F.min(n).alias(f"lo_{n}"), F.max(n).alias(f"hi_{n}"))]).first()
    spark, out = df.sparkSession, {}
    # (low, high, rank in the open interval's values) of each quantile's lower rank
    at = {n: [first[f"lo_{n}"], first[f"hi_{n}"], wanted[n][1] * (first[f"n_{n}"] - 1), first[f"n_{n}"]] for n in names if first[f"n_{n}"]}
    todo = {n for n in at if at[n][0] < at[n][1]}
    out |= {n: at[n][0] for n in at if n not in todo}
    stuck: set[str] = set()
    turn = 0
    while True:
        # until few values are left, or floating point cannot part them: then these are few in kind
        wide = {n for n in todo - stuck if at[n][3] > bins} if turn else set(todo)
        if not wide:
            break
        turn += 1
        before_turn = {n: (at[n][0], at[n][1]) for n in wide}
        pieces = []
        for n in sorted(wide):
            low, high = at[n][0], at[n][1]
            bin_ = F.least(F.lit(bins - 1), F.floor((F.col(n) - low) / (high - low) * bins)).cast("int")
            pieces.append(F.when(F.col(n).between(low, high), F.struct(F.lit(n).alias("name"), bin_.alias("bin"), F.col(n).alias("v"))))
        long = rows.select(F.explode(F.array_compact(F.array(*pieces))).alias("x")).groupBy("x.name", "x.bin").agg(F.count(F.lit(1)).alias("n"), F.min("x.v").alias("lo"), F.max("x.v").alias("hi"))
        found = sorted(long.collect())  # at most bins rows a quantile
        for n in wide:
            rank, before = at[n][2], 0
            mine = [r for r in found if r["name"] == n]
            for i, r in enumerate(mine):
                if rank < before + r["n"]:
                    high, count = r["hi"], r["n"]
                    if rank > before + r["n"] - 1 and i + 1 < len(mine):  # between the last of one bin and the first of the next
                        after = mine[i + 1]
                        f = rank - (before + r["n"] - 1)
                        out[n] = r["hi"] + f * (after["lo"] - r["hi"])
                        todo.discard(n)
                    at[n] = [r["lo"], high, rank - before, count]
                    break
                before += r["n"]
            if n in todo and at[n][0] == at[n][1]:
                out[n] = at[n][0]
                todo.discard(n)
            if (at[n][0], at[n][1]) == before_turn[n]:
                stuck.add(n)
    for n in sorted(todo):
        # few values, or values that floating point cannot part further: count them by value
        held = rows.filter(F.col(n).between(at[n][0], at[n][1])).groupBy(n).agg(F.count(F.lit(1)).alias("n")).orderBy(n).collect()
        rank, values = at[n][2], []
        low, high, upto = int(rank), int(rank) + 1, 0
        for value, k in held:
            values += [value for i in (low, high) if upto <= i < upto + k]
            upto += k
        out[n] = values[0] + (rank - low) * ((values[1] if len(values) > 1 else values[0]) - values[0])
    return spark.createDataFrame([tuple(float(out[n]) if n in out else None for n in names)], ", ".join(f"`{n}` double" for n in names))


def gini(df: DataFrame, by: str, value: str) -> DataFrame:
    """Gini coefficient and parcel statistics of each group, by sorted rank; 0 where the total is 0."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(value))
    rows = df.filter(F.col(value).isNotNull()).withColumn("_i", rank)
    n, total = F.count(F.lit(1)), F.sum(value)
    coefficient = F.when(total == 0, 0.0).otherwise(2 * F.sum(F.col("_i") * F.col(value)) / (n * F.when(total != 0, total)) - (n + 1) / n)
    return rows.groupBy(by).agg(n.alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), coefficient.alias("gini"))


def cut_points(df: DataFrame, value: str, parts: int = 64) -> list[float]:
    """At most parts - 1 values that cut the rows into parts of about the same size, from one approximate pass."""
    at = [i / parts for i in range(1, parts)]
    got = df.agg(F.percentile_approx(F.col(value).cast("double"), F.array(*[F.lit(x) for x in at]), F.lit(10_000)).alias("q")).first()[0]
    return sorted(set(got or []))


def part_of(value: Column, cuts: list[float]) -> Column:
    """Number of the part that a value is in: the cuts at or below it."""
    return F.size(F.filter(F.array(*[F.lit(float(x)) for x in cuts]), lambda x: x <= value)) if cuts else F.lit(0)


def running_total(df: DataFrame, value: str, amount: str, out: str, order: list[Column | str] | None = None, cuts: list[float] | None = None) -> DataFrame:
    """df with out, the sum of amount over the rows before it in order of value (then of order).

    Rows are cut into parts of about the same size; sums of whole parts (a few dozen rows) are added up first, and rows
    are ordered within their part alone, so no task orders all of them. Equal values lie in one part.
    """
    rows = df.withColumn("_part", part_of(F.col(value).cast("double"), cut_points(df, value) if cuts is None else cuts))
    parts = rows.groupBy("_part").agg(F.sum(amount).alias("_all"))
    before = F.coalesce(F.sum("_all").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("_part", before.alias("_start"))  # a row a part
    inside = F.sum(amount).over(Window.partitionBy("_part").orderBy(value, *(order or [])).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_in", F.coalesce(inside, F.lit(0))).join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + F.col("_in")).drop("_part", "_start", "_in")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: rank correlation with average ranks, over rows with both values."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    at = F.array(*[F.lit(i / 64) for i in range(1, 64)])
    both = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), at, F.lit(10_000)).alias(f"q{i}") for i, c in enumerate((x, y))]).first()
    for i, c in enumerate((x, y)):
        # ranks by value: each distinct value's rows and the rows before it, so ties meet in an aggregate first
        counts = running_total(rows.groupBy(c).agg(F.count(F.lit(1)).alias("_n")), c, "_n", "_before", cuts=sorted(set(both[i] or [])))
        rows = rows.join(counts.select(c, (F.col("_before") + (F.col("_n") + 1) / 2).alias(f"_r_{c}")), c)
    return rows.agg(F.corr(f"_r_{x}", f"_r_{y}").alias("rho"), F.count(F.lit(1)).alias("n"))


def spearman_p(rho: float, n: int) -> float:
    """Two-sided p-value of a rank correlation by Student's t; 0 where it is perfect, NaN with fewer than three rows."""
    from terrane.operators.ensemble import beta_cdf

    if n < 3 or rho != rho:
        return float("nan")
    if abs(rho) >= 1:
        return 0.0
    t2 = rho * rho * (n - 2) / (1 - rho * rho)
    return beta_cdf((n - 2) / (n - 2 + t2), (n - 2) / 2, 0.5)


def latest_as_of(df: DataFrame, key: list[str], when: str, until: Column, values: list[str]) -> DataFrame:
    """The last values of each key no later than a moment; ties by the values themselves."""
    best = F.max(F.struct(F.col(when), *[F.col(v) for v in values]))
    return df.filter(F.col(when) <= until).groupBy(*key).agg(best.alias("_b")).select(*key, *[F.col(f"_b.{v}").alias(v) for v in values], F.col(f"_b.{when}").alias(when))


def ratchet(df: DataFrame, key: str, when: list[str], rank: str, out: str = "ratcheted") -> DataFrame:
    """Highest rank so far in order of time; rows without a rank stay without."""
    w = Window.partitionBy(key).orderBy(*when).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.when(F.col(rank).isNotNull(), F.max(rank).over(w)))


def yearly_change(df: DataFrame, key: str, year: str, value: str, out: str) -> DataFrame:
    """Difference from the row before; 0 where either is null."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(year))
    return df.withColumn(out, F.coalesce(F.col(value) - before, F.lit(0.0)))


def percentile_cap(df: DataFrame, by: list[str], value: str, q: float, floor: float) -> DataFrame:
    """Values below the floor masked, those above the group's percentile capped."""
    cut = df.groupBy(*by).agg(F.percentile(value, F.lit(q)).alias("_cut"))
    return df.join(cut, by).withColumn("capped", F.when(F.col(value) >= floor, F.least(F.col(value), F.col("_cut")))).drop("_cut")


def monthly_mean(df: DataFrame, key: str, when: str, value: str) -> DataFrame:
    """(key, year, month, mean)."""
    return df.groupBy(key, F.year(when).alias("year"), F.month(when).alias("month")).agg(F.avg(value).alias("mean"))


def annual_median(df: DataFrame, key: str, when: str, value: str) -> DataFrame:
    """(key, year, median)."""
    return df.groupBy(key, F.year(when).alias("year")).agg(F.median(value).alias("median"))


def quarterly(df: DataFrame, when: str, value: str) -> DataFrame:
    """(year, quarter, units, price): how many were taken up, and their mean price."""
    return df.groupBy(F.year(when).alias("year"), F.quarter(when).alias("quarter")).agg(F.count(F.lit(1)).alias("units"), F.avg(value).alias("price"))


def forward_supply(projects: DataFrame, key: str, year: str, size: str) -> DataFrame:
    """(key, year, n, size) of what is due to open; projects without a year are left out."""
    return projects.filter(F.col(year).isNotNull()).groupBy(key, F.floor(year).alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias(size))


def outcomes(events: DataFrame, key: str, when: str, outcome: str, known: list[str]) -> DataFrame:
    """(key, outcome): the last of the known outcomes of each project."""
    return latest_as_of(events.filter(F.col(outcome).isin(*known)), [key], when, F.expr("TIMESTAMP_NTZ '9999-12-31 00:00:00'"), [outcome]).select(key, outcome)


def dead_share(projects: DataFrame, dead: str, least: int, least_share: float) -> DataFrame:
    """One row: how many projects died, their share, and whether these are enough for a test without survivorship."""
    out = projects.agg(F.count_if(dead).alias("n_dead"), F.avg(F.col(dead).cast("double")).alias("share"))
    return out.withColumn("ok", (F.col("n_dead") >= least) & (F.col("share") >= least_share))


def check_dead(projects: DataFrame, dead: str, least: int, least_share: float) -> DataFrame:
    """projects, if enough of them died; else it raises, since a test on survivors alone says nothing."""
    got = dead_share(projects, dead, least, least_share).first()
    if not got["ok"]:
        raise ValueError(f"{got['n_dead']} dead projects, a share of {got['share'] or 0.0:.3f}; {least} and {least_share} are needed")
    return projects


def clipped_date(when: Column, last_year: int) -> Column:
    """A date no later than the end of a year."""
    return F.to_date(F.least(when.cast("timestamp_ntz"), F.expr(f"TIMESTAMP_NTZ '{last_year}-12-31 00:00:00'")))


def district_totals(df: DataFrame, by: str, people: Column, expected: Column | float, tolerance: float) -> DataFrame:
    """(by, population, within): totals, and whether they are within a share of what is expected."""
    out = df.groupBy(by).agg(F.sum(people).alias("population"))
    expected = expected if isinstance(expected, Column) else F.lit(float(expected))
    return out.withColumn("within", F.abs(F.col("population") - expected) <= tolerance * expected)


def check_district_totals(df: DataFrame, by: str, people: Column, expected: Column | float, tolerance: float) -> DataFrame:
    """df, if all districts' totals are within the tolerance; else it raises and names the first of the others."""
    off = district_totals(df, by, people, expected, tolerance).filter("NOT coalesce(within, false)").orderBy(by).limit(5).collect()
    if off:
        raise ValueError("totals off by more than the tolerance: " + ", ".join(f"{r[by]} ({r['population']})" for r in off))
    return df


def zone_means(df: DataFrame, zone: str, value: str) -> DataFrame:
    """(zone, value, priced): mean, and whether any is known."""
    return df.groupBy(zone).agg(F.avg(value).alias(value), F.bool_or(F.col(value).isNotNull()).alias("priced"))


def price_test(df: DataFrame, zone: str, value: str, least: float) -> DataFrame:
    """One row: the share of zones with any value, and whether it is enough to test prices."""
    shares = zone_means(df, zone, value).agg(F.avg(F.col("priced").cast("double")).alias("share"))
    return shares.withColumn("enabled", F.col("share") >= least)


def bands(draws: DataFrame, by: list[str], value: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """p_low, median, p_high and width of each group."""
    out = draws.groupBy(*by).agg(F.percentile(value, F.array(F.lit(low), F.lit(0.5), F.lit(high))).alias("q"))
    return out.select(*by, F.col("q")[0].alias("p_low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p_high"), (F.col("q")[2] - F.col("q")[0]).alias("width"))


def converged(draws: DataFrame, by: str, value: str, draw: str, half: int, tolerance: float) -> DataFrame:
    """One row: the largest relative change of a median from the first draws to all of them, and whether it is small."""
    both = draws.groupBy(by).agg(F.median(F.when(F.col(draw) < half, F.col(value))).alias("a"), F.median(value).alias("b"))
    return both.agg(F.max(F.abs(F.col("a") - F.col("b")) / F.abs("b")).alias("worst")).withColumn("converged", F.col("worst") <= tolerance)


def majority(df: DataFrame, by: str, category: str, weight: str) -> DataFrame:
    """The heaviest category of each group, its share, and how many; ties go to the smallest name."""
    per = df.groupBy(by, category).agg(F.sum(weight).alias("_w"))
    best = F.min(F.struct(F.negative("_w").alias("k"), F.col(category)))
    return per.groupBy(by).agg(best.alias("_b"), F.max("_w").alias("_m"), F.sum("_w").alias("_t"), F.count(F.lit(1)).alias("n_classes")).select(
        by, F.col(f"_b.{category}").alias("majority"), (F.col("_m") / F.col("_t")).alias("share"), "n_classes"
    )


def fractions(df: DataFrame, by: str, category: str, weight: str) -> DataFrame:
    """Share of each category in its group."""
    per = df.groupBy(by, category).agg(F.sum(weight).alias("_w"))
    return per.withColumn("frac", F.col("_w") / F.sum("_w").over(Window.partitionBy(by))).drop("_w")


def zonal(df: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """Weighted zonal statistics of a long pixel table."""
    v, w = F.col(value), F.col(weight)
    return df.groupBy(by).agg((F.sum(v * w) / F.sum(w)).alias("z_mean"), F.sum(v * w).alias("z_sum"), F.sum(w).alias("z_count"), F.max(v).alias("z_max"))


def coverage(cells: DataFrame, key: str, columns: list[str], imputed: DataFrame, least: float) -> DataFrame:
    """Real, imputed and missing shares of each column, and whether real reaches the threshold."""
    flags = [F.struct(F.lit(c).alias("column"), F.col(c).isNotNull().alias("there")) for c in columns]
    long = cells.select(key, F.explode(F.array(*flags)).alias("_f")).select(key, "_f.column", "_f.there")
    marked = imputed.select(key, "column").distinct().withColumn("_imp", F.lit(True))
    n = F.count(F.lit(1))
    share = lambda cond: F.sum(F.when(cond, 1.0).otherwise(0.0)) / n
    imp = F.coalesce("_imp", F.lit(False))
    out = long.join(marked, [key, "column"], "left").groupBy("column").agg(share(F.col("there") & ~imp).alias("real"), share(F.col("there") & imp).alias("imputed"), share(~F.col("there")).alias("missing"))
    return out.withColumn("passes", F.col("real") >= least)


def confidence(columns: DataFrame, key: str, weight: str, base: float, floor: float, missing: Column | None = None, penalty: float = 0.0) -> DataFrame:
    """base less the weights of imputed columns and a penalty for each missing one, within [floor, 1].

    columns has a row for each imputed or missing column of a key; where missing is true the penalty counts instead of
    the weight.
    """
    gone = F.lit(False) if missing is None else F.coalesce(missing, F.lit(False))
    loss = F.sum(F.when(gone, F.lit(float(penalty))).otherwise(F.col(weight)))
    return columns.groupBy(key).agg(F.greatest(F.lit(floor), F.least(F.lit(1.0), F.lit(base) - F.coalesce(loss, F.lit(0.0)))).alias("data_conf"))


def panel_median(observations: DataFrame, key: str, price: Column, least: int) -> DataFrame:
    """(key, price, n): the median of a panel's prices for each key; null where fewer than least are known."""
    out = observations.groupBy(key).agg(F.median(price).alias("price"), F.count(price).alias("n"))
    return out.withColumn("price", F.when(F.col("n") >= least, F.col("price")))


def wide_band(quantiles: DataFrame, by: list[str], names: dict[float, str], value: str = "value") -> DataFrame:
    """(by..., a column for each quantile) of long quantiles (by..., quantile, value); one that is not there is null."""
    cols = [F.max(F.when(F.abs(F.col("quantile") - q) < 1e-9, F.col(value))).alias(name) for q, name in names.items()]
    return quantiles.groupBy(*by).agg(*cols)


def long_loadings(df: DataFrame, by: list[str], factors: list[str], value: str = "value") -> DataFrame:
    """(by..., factor, value): a row for each factor's loading, missing ones too."""
    return df.select(*by, *[F.col(f).cast("double").alias(f) for f in factors]).unpivot(by, factors, "factor", value)


def city_growth(df: DataFrame, year: str, value: str, first: int, last: int, low: float, high: float) -> DataFrame:
    """One row: the yearly growth of the mean between two years, within [low, high]; null where a mean is not above 0."""
    mean = lambda y: F.avg(F.when(F.col(year) == y, F.col(value)))
    out = df.agg(mean(first).alias("_a"), mean(last).alias("_b"))
    good = (F.col("_a") > 0) & (F.col("_b") > 0)
    return out.select(F.when(good, F.greatest(F.lit(low), F.least(F.lit(high), F.pow(F.col("_b") / F.when(good, F.col("_a")), F.lit(1.0 / (last - first))) - 1))).alias("cagr"))


def priority_tier(df: DataFrame, impact: str, key: str, n: int) -> DataFrame:
    """(key, rank): the n of most impact, ranked from 1; ties by key. Spark keeps n rows a task, so no task orders all."""
    top = df.orderBy(F.desc(impact), key).limit(n)
    return top.select(key, F.row_number().over(Window.orderBy(F.desc(impact), key)).alias("rank"))


def ledger_index(df: DataFrame, by: list[str], flag: str, method: str) -> DataFrame:
    """Whether anything was imputed, and the distinct methods in order."""
    return df.groupBy(*by).agg(F.bool_or(flag).alias("imputed"), F.array_join(F.array_sort(F.collect_set(method)), ";").alias("methods"))


def cagr(df: DataFrame, key: str, year: str, value: str, first: int, last: int, low: float, high: float) -> DataFrame:
    """Compound growth between two years, clipped; the whole's where a key lacks either."""
    at = lambda y: F.avg(F.when(F.col(year) == y, F.col(value)))
    growth = lambda a, b: F.when((a > 0) & (b > 0), F.greatest(F.lit(low), F.least(F.lit(high), F.pow(b / F.when(a > 0, a), F.lit(1.0 / (last - first))) - 1)))
    own = df.groupBy(key).agg(at(first).alias("_a"), at(last).alias("_b"))
    whole = df.agg(at(first).alias("_c"), at(last).alias("_d"))
    rows = own.join(F.broadcast(whole))
    mine = growth(F.col("_a"), F.col("_b"))
    return rows.select(key, F.coalesce(mine, growth(F.col("_c"), F.col("_d"))).alias("cagr"), mine.isNull().alias("fallback"))


def top_k_precision(df: DataFrame, key: str, pred: str, actual: str, k: int, q: float) -> DataFrame:
    """Share of the k highest predictions whose actual reaches a percentile of all."""
    cut = quantiles(df, {"_cut": (actual, q)})
    top = df.orderBy(F.desc(pred), key).limit(k)
    return top.join(F.broadcast(cut)).agg(F.avg((F.col(actual) >= F.col("_cut")).cast("double")).alias("precision"), F.count(F.lit(1)).alias("k"))


def band_coverage(df: DataFrame, actual: str, low: str, high: str) -> DataFrame:
    return df.agg(F.avg(F.col(actual).between(F.col(low), F.col(high)).cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n"))


def aligned(pred: DataFrame, actual: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """(key, pred, actual) of keys that both have a value for; NaN counts as none."""
    there = lambda df, name: df.select(*key, F.col(value).cast("double").alias(name)).filter(F.col(name).isNotNull() & ~F.isnan(name))
    return there(pred, "pred").join(there(actual, "actual"), key)


def mape(df: DataFrame, pred: str, actual: str, least: float) -> DataFrame:
    """Mean absolute percentage error over rows whose actual is not near 0."""
    rows = df.filter(F.abs(actual) >= least)
    return rows.agg(F.avg(F.abs((F.col(pred) - F.col(actual)) / F.col(actual))).alias("mape"), F.count(F.lit(1)).alias("n"))


def blend(ask: Column, registered: Column, uplift: Column, weight: float) -> Column:
    """Mix of the asking price and the uplifted registered one; the one that is there where the other is null."""
    lifted = registered * uplift
    return F.when(ask.isNotNull() & lifted.isNotNull(), weight * ask + (1 - weight) * lifted).otherwise(F.coalesce(ask, lifted))


def parent_median(df: DataFrame, value: str, parent: str, least: int) -> DataFrame:
    """Nulls take the median of their parent, if it has enough observations."""
    by = df.groupBy(parent).agg(F.median(value).alias("_m"), F.count(value).alias("_n"))
    filled = F.when(F.col(value).isNull() & (F.col("_n") >= least), F.col("_m")).otherwise(F.col(value))
    return df.join(by, parent).withColumn("filled", filled).withColumn("was_filled", F.col(value).isNull() & (F.col("_n") >= least)).drop("_m", "_n")


def delivery_record(df: DataFrame, key: str, project: str, planned: str, done: str, slip: str) -> DataFrame:
    """Distinct projects, totals, delivered share and median slip of each promoter."""
    out = df.groupBy(key).agg(F.countDistinct(project).alias("n_projects"), F.sum(planned).alias("planned"), F.sum(done).alias("done"), F.median(slip).alias("median_slip"))
    return out.withColumn("ratio", F.when(F.col("planned") > 0, F.col("done") / F.when(F.col("planned") > 0, F.col("planned"))))


def composites(scenes: DataFrame, key: str, month: Column, pixel: str, value: str, clear: Column, least: float) -> DataFrame:
    """Per-pixel median over clear scenes, then the mean over pixels; months with too little clear are dropped."""
    px = scenes.groupBy(F.col(key), month.alias("month"), F.col(pixel)).agg(F.median(F.when(clear, F.col(value))).alias("_v"), F.max(clear.cast("int")).alias("_c"))
    out = px.groupBy(key, "month").agg(F.avg("_v").alias("value"), F.avg(F.col("_c").cast("double")).alias("clear"))
    return out.filter(F.col("clear") >= least)


def read_where(df: DataFrame, **filters) -> DataFrame:
    """Equality, IN-list and IS NULL filters, pushed to the scan; an empty list selects nothing; unknown names raise."""
    for name, value in filters.items():
        if name not in df.columns:
            raise KeyError(name)
        if isinstance(value, (list, tuple, set)):
            df = df.filter(F.col(name).isin(*value) if value else F.lit(False))
        else:
            df = df.filter(F.col(name).isNull() if value is None else F.col(name) == value)
    return df


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows without a new one, and the new rows."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def violations(df: DataFrame, checks: dict[str, Column], unique: list[str]) -> DataFrame:
    """(check, n) of every failed check, in one pass for the rules and one for the key."""
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()])
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("n")) for n in checks])).alias("_c")).select("_c.check", "_c.n")
    again = df.groupBy(*unique).count().filter("count > 1").agg(F.lit("unique").alias("check"), F.count(F.lit(1)).alias("n"))
    return long.unionByName(again).filter("n > 0")


def queue_decisions(candidates: DataFrame, threshold: float) -> DataFrame:
    """Automatic decision of each candidate: confident updates apply, all else waits for a reviewer."""
    c = F.col
    return candidates.withColumn("decision", F.when((c("confidence") >= threshold) & ~c("is_new") & ~c("is_stage_change"), "auto_applied").otherwise("pending"))


def licence_class(text: Column, exact: dict[str, str], patterns: list[tuple[str, str]]) -> Column:
    """Class of a licence text: exact names first, then patterns in order, else unknown."""
    low = F.lower(F.trim(text))
    out = F.when(text.isNull() | (low == ""), "unknown")
    for name, label in exact.items():
        out = out.when(low == name, label)
    for pattern, label in patterns:
        out = out.when(low.rlike(pattern), label)
    return out.otherwise("unknown")
