"""Hand-computed answers, closed forms and refusals of the hydrologic engine."""

import math
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from headwater.functions import calendar as cal
from headwater.functions import censored as C
from headwater.functions import special as S
from headwater.functions.expressions import EquationError, compile_expression, variables
from headwater.operators import dimensions
from headwater.operators import frequency as Q
from headwater.operators import lowflow as L
from headwater.operators import peaks as P
from headwater.operators import records as X
from headwater.operators import regime as R
from headwater.operators import trend as T
from headwater.sources import readers


def series(spark, values, start=date(2000, 10, 1), site="a"):
    rows = [(site, start + timedelta(i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "site string, date date, flow double").filter("flow IS NOT NULL")


def test_year_labels_and_day_of_water_year(spark):
    d = spark.createDataFrame([(date(2000, 9, 30),), (date(2000, 10, 1),), (date(2001, 2, 28),), (date(2001, 3, 1),)], "date date")
    rows = d.select(cal.year_label(F.col("date")).alias("w"), cal.year_label(F.col("date"), "climatic").alias("c"), cal.day_of_water_year(F.col("date")).alias("k")).collect()
    assert [(r.w, r.c, r.k) for r in rows] == [(2000, 2000, 366), (2001, 2000, 1), (2001, 2000, 151), (2001, 2000, 153)]
    with pytest.raises(ValueError):
        cal.season(F.col("date"), {"all": (1, 2)})


def test_flashiness_of_a_zigzag(spark):
    r = R.flashiness(series(spark, [10, 20] * 10), min_days=1).first()
    assert r.flashiness == pytest.approx(19 * 10 / 300) and r.n_days == 20 and r.complete


def test_a_gap_is_not_bridged(spark):
    low = L.annual_minimum(series(spark, [5] * 6 + [None] + [7] * 7), 7, "water", 1).first()
    assert low.min_flow == 7.0 and low.date == date(2000, 10, 14)


def test_baseflow_stays_below_flow(spark):
    flows = [50 + 40 * math.sin(i / 9) + (200 if i % 37 == 0 else 0) for i in range(400)]
    daily = series(spark, flows)
    for method, options in (("smoothed_minima", {}), ("recursive_filter", {}), ("fixed_interval", {"area_sqmi": 100.0}), ("sliding_interval", {"area_sqmi": 100.0}), ("local_minimum", {"area_sqmi": 100.0})):
        bad = R.separate_baseflow(daily, method, **options).filter("baseflow > flow + 1e-9 OR baseflow < 0").count()
        assert bad == 0, method
    with pytest.raises(ValueError):
        R.separate_baseflow(daily, "fixed_interval")
    with pytest.raises(ValueError):
        R.separate_baseflow(daily, "other")
    assert R.interval_days(1.0) == 1 and R.interval_days(1000.0) == 7


def test_results_do_not_depend_on_partitions(spark):
    daily = series(spark, [3 + (i * 7919 % 101) for i in range(500)])
    one = sorted(map(tuple, R.smoothed_minima(daily.repartition(1)).collect()))
    assert one == sorted(map(tuple, R.smoothed_minima(daily.repartition(16)).collect()))


def test_peak_codes(spark):
    d = spark.createDataFrame([("4,C",), ("7.0",), ("Bd6",), (None,)], "code string")
    got = [set(r.c) for r in d.select(P.parse_codes(F.col("code")).alias("c")).collect()]
    assert got == [{"4", "C"}, {"7"}, {"Bd", "6"}, set()]
    peaks = spark.createDataFrame([("a", 1, 5.0, "4"), ("a", 2, 6.0, "8"), ("a", 3, 7.0, "3"), ("a", 4, 8.0, "7")], "site string, year int, flow double, code string")
    rows = {r.year: r for r in P.peak_intervals(peaks).collect()}
    assert rows[1].lower == 1e-20 and rows[2].upper == 1e20 and rows[3].removed and rows[4].historic
    with pytest.raises(Exception, match="negative"):
        P.peak_intervals(peaks.withColumn("flow", F.lit(-1.0))).collect()


def test_extension_recovers_a_power_law(spark):
    index = series(spark, [10 + i for i in range(60)], site="x")
    short = series(spark, [2 * (10 + i) ** 1.5 for i in range(30)], site="y")
    rows = X.extend(short, index).filter("source = 'move1'").collect()
    assert len(rows) == 30 and all(r.flow == pytest.approx(2 * (10 + (r.date - date(2000, 10, 1)).days) ** 1.5, rel=1e-6) for r in rows)


def test_trend_of_a_line_and_of_its_mirror(spark):
    rows = [("up", i, float(i)) for i in range(20)] + [("down", i, float(-i)) for i in range(20)]
    s = spark.createDataFrame(rows, "site string, year int, flow double")
    mk = {r.site: r for r in T.mann_kendall(s).collect()}
    assert mk["up"].s == 190 and mk["down"].s == -190 and mk["up"].z == -mk["down"].z and mk["up"].tau == 1
    slope = {r.site: r for r in T.sens_slope(s).collect()}
    assert slope["up"].slope == 1 and slope["up"].intercept == 0


def test_change_point(spark):
    s = spark.createDataFrame([("a", 1990 + i, 1.0 if i < 10 else 9.0) for i in range(25)], "site string, year int, flow double")
    r = T.pettitt(s).first()
    assert (r["index"], r.year, r["shift"]) == (10, 2000, "up")
    tests = {r.test: r for r in T.screen(s, 199).collect()}
    assert tests["lombard_abrupt_wilcoxon"]["index"] == 10 and tests["cusum"].p_value < 0.05


def test_pot_gap_starts_an_event(spark):
    values = [1.0] * 40
    values[5] = values[12] = values[18] = 9.0
    events = T.pot_events(series(spark, values), 5.0, 7, 1).collect()
    assert sorted(e.peak_date for e in events) == [date(2000, 10, 6), date(2000, 10, 13)]


def test_special_functions():
    assert S.gamma_p(3.0, 2.5) == pytest.approx(1 - math.exp(-2.5) * (1 + 2.5 + 2.5**2 / 2))
    assert S.gamma_p(2.0, S.gamma_quantile(0.3, 2.0)) == pytest.approx(0.3)
    assert S.pearson3_quantile(0.99, 0.0) == pytest.approx(2.3263478740408408)
    # the exponential distribution is Pearson III with skew 2
    assert S.pearson3_quantile(0.99, 2.0) == pytest.approx(-math.log(0.01) - 1)
    assert S.pearson3_quantile(0.01, -2.0) == pytest.approx(1 + math.log(0.01))
    assert S.t_quantile(0.975, 10) == pytest.approx(2.2281388519649385, rel=1e-9)
    assert S.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, rel=1e-9)


def test_outlier_probability_against_simulation():
    z = np.sort(np.random.default_rng(1).normal(size=(60_000, 20)), axis=1)
    upper = z[:, 3:]
    w = (z[:, 2] - upper.mean(axis=1)) / upper.std(axis=1, ddof=1)
    assert C.outlier_p(20, 3, -1.6) == pytest.approx((w <= -1.6).mean(), abs=0.02)


def test_exact_peaks_give_sample_moments():
    x = np.random.default_rng(3).normal(3, 0.3, 40)
    mean, sd, skew, _ = C.expected_moments(x, x)
    n = len(x)
    assert mean == pytest.approx(x.mean()) and sd == pytest.approx(x.std(ddof=1))
    assert skew == pytest.approx(n / ((n - 1) * (n - 2)) * ((x - x.mean()) ** 3).sum() / sd**3)


def test_censored_fit_recovers_the_mean():
    x = np.random.default_rng(4).normal(3, 0.3, 400)
    lo, hi = x.copy(), x.copy()
    lo[x < 2.8], hi[x < 2.8] = -20, 2.8
    mean, sd, skew, _ = C.expected_moments(lo, hi)
    assert mean == pytest.approx(3, abs=0.05) and sd == pytest.approx(0.3, abs=0.05)


def test_low_outliers_are_found(spark):
    x = np.concatenate([np.random.default_rng(5).normal(3, 0.1, 50), [0.5, 0.6]])
    assert C.low_outliers(x)[0] == 2
    rows = spark.createDataFrame([("a", float(10**v)) for v in x] + [("b", 1.0)], "site string, flow double")
    fits = Q.fit_peaks(rows).collect()
    assert {r.n_low for r in fits if r.site == "a"} == {2}
    assert [r.error for r in fits if r.site == "b"] == ["fewer than 3 exact peaks"]


def test_compiled_equations(spark):
    d = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    value = lambda text: d.select(compile_expression(text).alias("x")).first().x
    assert value("2^3^2") == 512 and value("-a^2") == -4 and value("a-b-1") == -2 and value("max(a, b)*exp(0)/e^0") == 3 and value("logN(8, 2)") == pytest.approx(3)
    assert variables("a*(b+a)^e - max(c, 1)") == ["a", "b", "c"]
    for bad in ("a +", "a $ b", "foo(a)", "(a", "a b"):
        with pytest.raises(EquationError):
            compile_expression(bad, lambda n: F.lit(1.0))


def test_files(spark, tmp_path):
    d = series(spark, [1, 2, 3])
    for name in ("x.parquet", "x.csv", "x.csv.gz"):
        readers.write_flow(d, str(tmp_path / name))
        assert readers.read_flow(spark, str(tmp_path / name)).count() == 3
    with pytest.raises(ValueError):
        readers.read_flow(spark, "x.doc")
    with pytest.raises(readers.AmbiguousColumn):
        readers.value_column(["1_00060", "2_00060"], "00060")
    spec = readers.specification("' note\nStation 123\n PCPT_Thresh 1900 1950 10 1e20\n Interval 1920 5 9\n SkewOpt Weighted\n")
    assert spec["123"]["thresholds"] == [(1900, 1950, 10.0, 1e20)] and spec["123"]["options"] == {"SkewOpt": "Weighted"}
    with pytest.raises(ValueError):
        readers.specification("Station 1\nStation 1\n")


def test_conflicting_readings_raise(spark):
    f = spark.createDataFrame([("s", "00060", "x", "2020-01-01T00:00:00Z", v, "Approved", []) for v in ("1", "2")], "monitoring_location_id string, parameter_code string, time_series_id string, time string, value string, approval_status string, qualifier array<string>")
    with pytest.raises(Exception, match="two readings"):
        readers.continuous(f, "00060").collect()
    assert readers.continuous(f.filter("value = '1'").unionAll(f.filter("value = '1'")), "00060").count() == 1


def test_streaming_days(spark, tmp_path):
    from headwater.streaming import live

    rows = [("a", datetime(2024, 1, 1 + h // 24, h % 24), float(h)) for h in range(72)]
    spark.createDataFrame(rows, "site string, ts timestamp, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("site string, ts timestamp, value double").parquet(str(tmp_path / "in"))
    q = live.diel_windows(stream).writeStream.outputMode("append").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM days ORDER BY date").collect()
    assert (got[0].min, got[0].max, got[0].n) == (0.0, 23.0, 24)


def test_empty_series(spark):
    none = series(spark, [])
    assert R.flashiness(none).count() == 0 and L.annual_minimum(none).count() == 0 and R.smoothed_minima(none).count() == 0


def test_bootstrap_limits_follow_the_skew(spark):
    from headwater.functions import special
    from headwater.operators import frequency

    rng = np.random.default_rng(4)
    logs = 1 + 0.4 * (rng.gamma(1.0, size=40) - 1)
    got = {r.non_exceedance: r for r in frequency.bootstrap_limits(spark.createDataFrame([("a", float(10**x)) for x in logs], "site string, min_flow double")).collect()}
    skewness = lambda y: float(np.clip(len(y) * ((y - y.mean()) ** 3).sum() / ((len(y) - 1) * (len(y) - 2) * y.std(ddof=1) ** 3), -3, 3))
    factors = np.array([special.frequency_factor(skewness(logs), 1 - p) for p in (np.arange(2000) + 0.5) / 2000])
    want = {0.1: [], 0.5: []}
    for _ in range(1500):
        y = logs.mean() + logs.std(ddof=1) * rng.choice(factors, 40)
        for p, d in want.items():
            d.append(y.mean() + special.frequency_factor(skewness(y), 1 - p) * y.std(ddof=1))
    for p, d in want.items():
        assert got[p].n_used == 2000
        assert np.log10([got[p].lower, got[p].upper]) == pytest.approx(np.quantile(d, [0.05, 0.95]), abs=0.025)


def test_field_bootstrap_draws_blocks(spark):
    from headwater.operators import trend

    rows = [(s, y, float(y * (s == "a") + (y * 7) % 11)) for s in "ab" for y in range(20)] + [("c", y, 1.0) for y in range(9)]
    values = spark.createDataFrame(rows, "site string, year int, flow double")
    whole = trend.field_bootstrap(values, block_length=20).first()
    assert whole.n_sites == 2 and whole.p_value == 1.0
    assert trend.field_bootstrap(values).first().p_value < 1.0


# Published fits of two public gages (see the query's module): station and weighted skew, error of the skew.
PUBLISHED = {"06327450": (11, -0.70789, -0.60417, 0.221189), "03606500": (0, 0.0066, -0.15631, 0.094375)}


@pytest.mark.parametrize("site", sorted(PUBLISHED))
def test_published_fits(site):
    from headwater.plans import q_dimensions as K

    flows = [float(x) for x in K.PEAKS[site].split()]
    tl = [1e-20] * len(flows)
    lower, upper = flows[:], flows[:]
    if site == "03606500":
        historic = [float(x) for x in K.HISTORIC.split()]
        lower += historic + [1e-20] * K.CENSORED_YEARS
        upper += historic + [K.THRESHOLD] * K.CENSORED_YEARS
        tl += [K.THRESHOLD] * (len(historic) + K.CENSORED_YEARS)
    logs = [np.log10(x) for x in (lower, upper, tl)]
    f = C.fit(logs[0], logs[1], *K.REGIONAL[site], tl=logs[2], tu=np.full(len(tl), 20.0))
    low, station, weighted, mse = PUBLISHED[site]
    assert f.n_low == low and f.station_skew == pytest.approx(station, abs=3e-3) and f.skew == pytest.approx(weighted, abs=3e-4) and f.skew_mse == pytest.approx(mse, rel=2e-3)
    alone = C.fit(logs[0], logs[1], *K.REGIONAL[site], tl=logs[2], tu=np.full(len(tl), 20.0), option="regional")
    assert alone.skew == pytest.approx(K.REGIONAL[site][0], abs=1e-6)
    assert C.fit(logs[0], logs[1], *K.REGIONAL[site], tl=logs[2], tu=np.full(len(tl), 20.0), option="station").skew == f.station_skew


def test_outlier_probability_against_simulation():
    rng = np.random.default_rng(2)
    x = np.sort(rng.standard_normal((40_000, 20)), axis=1)
    for rank, w in ((1, -3.0), (3, -2.2), (6, -1.6)):
        above = x[:, rank:]
        share = ((x[:, rank - 1] - above.mean(axis=1)) / above.std(axis=1, ddof=1) <= w).mean()
        assert C.outlier_p(20, rank, w) == pytest.approx(share, abs=0.012)


def test_region_moments_against_the_whole():
    from headwater.functions import moments as M

    for g in (-1.3, -0.1, 0.07, 0.9):
        p, m = M.region(-math.inf, math.inf, 2.0, 0.5, g, 3)
        assert p == pytest.approx(1, abs=1e-6) and M.central(m) == pytest.approx((2.0, 0.25, g), rel=1e-4)
        assert M.region(-math.inf, 2.3, 2.0, 0.5, g, 1)[0] == pytest.approx(S.pearson3_cdf(2.3, 2.0, 0.5, g), abs=1e-6)
    whole = ((50.0, -math.inf, math.inf),)
    assert M.raw_covariance(whole, 0.5)[0, 0] == pytest.approx(1 / 50, rel=1e-9)
    assert M.skew_error(((30.0, -math.inf, math.inf), (60.0, 1.2, math.inf)), 0.3) < M.skew_error(((30.0, -math.inf, math.inf),), 0.3)


def test_guards_refuse(spark):
    from headwater.operators import dimensions as D

    sites = spark.createDataFrame([("a", "regulated", "12345678"), ("b", "urban", "12345678")], "site string, class string, code string")
    assert D.catalog(sites).count() == 2
    for bad in (sites.unionAll(sites.limit(1)), sites.withColumn("class", F.lit("odd")), sites.withColumn("code", F.lit("123"))):
        with pytest.raises(Exception, match="repeated|unknown class|8 digits"):
            D.catalog(bad).collect()
    with pytest.raises(Exception, match="regulated record"):
        D.require_unregulated(sites).collect()
    pair = spark.createDataFrame([("regulated", "urban")], "donor_class string, target_class string")
    with pytest.raises(Exception, match="an unregulated"):
        D.check_transfer(pair).collect()
    assert D.check_transfer(pair, allow=True).first().regulation_override
    rules = spark.createDataFrame([("01", ["A", "B"], 1.0), ("01", ["B"], 2.0)], "prefix string, states array<string>, value double")
    with pytest.raises(Exception, match="two rules"):
        D.rule_table(rules).collect()
    peaks = spark.createDataFrame([("a", 1990, 5.0, 4.0)], "site string, year int, lower double, upper double")
    for check in (D.interval_peaks, D.perception_bounds):
        with pytest.raises(Exception, match="invalid|above its upper"):
            check(peaks).collect()
    with pytest.raises(Exception, match="not given here"):
        spark.range(1).select(D.high_boundary_ft(F.lit(41.5))).collect()
    dry = spark.createDataFrame([("a", 0.1, 0.0, 0.2, "sand", 1.0, 1.0)], "site string, non_exceedance double, flow double, p_zero double, setting string, donor_area double, target_area double")
    with pytest.raises(Exception, match="goes dry"):
        D.transpose_low_flow(dry, spark.createDataFrame([(0.1, 1.0)], "non_exceedance double, b double")).collect()


def test_finer_units_with_other_values_are_refused(spark):
    rules = spark.createDataFrame([("05", "x"), ("0501", "y")], "prefix string, value string")
    fine = spark.createDataFrame([("a", "05011234"), ("b", "05021234")], "site string, code string")
    assert {r.site: r.value for r in P.longest_prefix(fine, rules).collect()} == {"a": "y", "b": "x"}
    with pytest.raises(Exception, match="units within"):
        P.longest_prefix(spark.createDataFrame([("c", "05")], "site string, code string"), rules).collect()
    with pytest.raises(Exception, match="several values"):
        P.longest_prefix(fine, rules.union(spark.createDataFrame([("05", "z")], rules.schema))).collect()


def test_season_of_peaks(spark):
    from headwater.operators import trend

    rows = spark.createDataFrame([("a", date(2001, 1, 1)), ("a", date(2002, 12, 31)), ("b", date(2001, 4, 2)), ("b", date(2001, 10, 1))], "site string, date date")
    got = {r.site: r for r in trend.mixed_population(rows).collect()}
    assert got["a"].cool_share == 1.0 and not got["a"].mixed and got["a"].concentration > 0.99 and min(got["a"].mean_day, 365.25 - got["a"].mean_day) < 1
    assert got["b"].cool_share == 0.5 and got["b"].mixed and got["b"].concentration < 0.01


def test_dams_and_inventory(spark, tmp_path):
    from headwater.operators import dimensions as D

    (tmp_path / "nid.csv").write_text('Data Last Updated:,2024-5-1\n"NID ID",Longitude,Latitude,Storage\nD1,-114.0,42.0,10\nD1,-114.0,42.0,12\n,-113.5,42.5,5\n,-113.5,42.5,5\nD2,,42,7\n')
    names = {"NID ID": "dam_id", "Longitude": "lon", "Latitude": "lat", "Storage": "storage"}
    assert sorted((r.dam_id or "", r.storage) for r in D.read_dams(spark, str(tmp_path / "nid.csv"), names).collect()) == [("", 5.0), ("", 5.0), ("D1", 10.0)]
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        D.read_dams(spark, str(tmp_path / "other.csv"), names)


def test_regional_skew_recovers_a_plane(spark):
    from headwater.operators import estimators

    rng = np.random.default_rng(5)
    rows = [("r", f"s{i}", float((0.1 + 0.3 * x + rng.normal(0, 0.05)) / (1 + 6 / 400)), 400, float(x)) for i, x in enumerate(np.linspace(-1, 1, 60))]
    d = spark.createDataFrame(rows, "region string, site string, skew double, n int, x double")
    got = {r.term: r for r in estimators.regional_skew(d, ("x",)).collect()}
    assert got["constant"].coef == pytest.approx(0.1, abs=0.04) and got["x"].coef == pytest.approx(0.3, abs=0.06)
    assert got["x"].model_variance < 0.02 and got["x"].effective_years > 200


def test_zones_and_smooth_exponents(spark):
    from headwater.operators import estimators

    rows = spark.createDataFrame([("CST", "Y"), ("MST", "n"), ("ChST", "N")], "a string, d string")
    assert [r.z for r in rows.select(cal.zone_of(F.col("a"), F.col("d")).alias("z")).collect()] == ["America/Chicago", "-07:00", "+10:00"]
    with pytest.raises(Exception, match="no zone"):
        spark.createDataFrame([("XST", "Y")], "a string, d string").select(cal.zone_of(F.col("a"), F.col("d"))).collect()
    points = [(-1.0, 0.9), (0.0, 0.8), (1.0, 0.8), (2.0, 0.5)]
    z = spark.createDataFrame([(x / 10,) for x in range(-15, 26)], "z double")
    got = {round(r.z, 1): r.b for r in z.select("z", estimators.smooth_exponent_at(F.col("z"), points).alias("b")).collect()}
    assert all(got[a] == pytest.approx(b) for a, b in points) and got[-1.5] == 0.9 and got[2.5] == 0.5
    assert all(got[x / 10] == pytest.approx(0.8) for x in range(0, 11))  # flat between equal points
    line = [got[x / 10] for x in range(-10, 21)]
    assert all(b <= a + 1e-12 for a, b in zip(line, line[1:]))


def test_conditional_moments(spark):
    logs = [2.0, 2.1, 2.2, 2.3, 2.4, 2.5, 2.6, 2.2, 2.3, 2.4, 2.35, 2.25, -2.0]
    d = spark.createDataFrame([("a", 10.0**x) for x in logs], "site string, flow double")
    got = {r.aep: r for r in Q.conditional_moment_quantiles(d, (0.95, 0.1)).collect()}
    x = np.array(logs[:-1])
    g = len(x) * ((x - x.mean()) ** 3).sum() / ((len(x) - 1) * (len(x) - 2) * x.std(ddof=1) ** 3)
    assert got[0.1].n_low == 1 and got[0.1].flow == pytest.approx(10 ** (x.mean() + S.frequency_factor(g, 0.1 * 13 / 12) * x.std(ddof=1)))
    assert got[0.95].flow is None


def test_pairs_that_are_asked_for(spark):
    from headwater.operators import transfer

    rng = np.random.default_rng(3)
    daily = None
    for k, site in enumerate("abc"):
        one = series(spark, (rng.random(60) * (k + 1) + 1).tolist(), site=site)
        daily = one if daily is None else daily.union(one)
    pairs = spark.createDataFrame([("a", "b"), ("c", "a")], "site string, donor string")
    some = {(r.site, r.donor): r for r in X.rank_donors(daily, daily, 30, pairs).collect()}
    every = {(r.site, r.donor): r for r in X.rank_donors(daily, daily, 30).collect()}
    assert set(some) == {("a", "b"), ("c", "a")} and all(some[k] == every[k] for k in some) and len(every) == 6
    yearly = daily.select("site", F.dayofyear("date").alias("year"), "flow")
    one = {(r.site, r.other): r.cov for r in transfer.cross_covariance(yearly, pairs.withColumnRenamed("donor", "other")).collect()}
    two = {(r.site, r.other): r.cov for r in transfer.cross_covariance(yearly).collect()}
    assert one[("a", "b")] == pytest.approx(two[("a", "b")]) and one[("c", "a")] == pytest.approx(two[("a", "c")])


@pytest.mark.parametrize("band", [(0, 1), (1.5, 0.5), (0.5, math.inf), (-1, 2)])
def test_bands_are_checked(band):
    from headwater.operators import transfer

    with pytest.raises(ValueError, match="low <= high"):
        transfer.checked_band("band", band)


def test_cells_round_as_the_sql_does(spark):
    rows = spark.createDataFrame([(9.155,), (9.995,), (9.325,), (0.0,), (12.25,), (None,)], "x double")
    assert [r.x for r in rows.select(dimensions.flow_cell(F.col("x")).alias("x")).collect()] == ["9.15", "9.99", "9.32", "0", "12.3", "-"]


def test_networks_are_fitted_without_matrices_of_gages_by_gages(spark):
    import tracemalloc

    from headwater.operators import estimators

    def dense(y, x, sigma, g2):
        w = np.linalg.inv(sigma + g2 * np.eye(len(y)))
        cov = np.linalg.inv(x.T @ w @ x)
        e = y - x @ (cov @ x.T @ w @ y)
        return cov @ x.T @ w @ y, cov, e @ w @ e

    r = np.random.default_rng(1)
    x, v = np.column_stack([np.ones(30), r.normal(size=30)]), r.uniform(0.001, 0.05, 30)
    y = x @ [1, 2] + r.normal(size=30) * 0.4
    b, g2, cov = estimators.solve_gls(y, x, v, 0.3)
    want = dense(y, x, np.sqrt(np.outer(v, v)) * np.where(np.eye(30, dtype=bool), 1.0, 0.3), g2)
    assert np.allclose(b, want[0]) and np.allclose(cov, want[1]) and want[2] == pytest.approx(28)
    n = 6000
    rows = spark.range(n).select(F.lit("a").alias("region"), F.col("id").cast("string").alias("site"), (F.col("id") % 7 / 10).alias("skew"), (20 + F.col("id") % 9).alias("n"))
    kernel = []
    rows_ = type("Rows", (), {"groupBy": lambda self, *_: self, "applyInPandas": lambda self, f, _: kernel.append(f)})()
    estimators.regional_skew(rows_, (), 0.1)
    tracemalloc.start()
    estimators.solve_gls(r.normal(size=n), np.ones((n, 1)), np.full(n, 0.01), 0.2)
    out = kernel[0](rows.toPandas())
    assert out["n_sites"][0] == n and tracemalloc.get_traced_memory()[1] < 60e6  # a matrix would take 288 MB
    tracemalloc.stop()


@pytest.fixture(scope="module")
def keyed(spark):
    r = np.random.default_rng(4)
    rows = [(f"s{i:03d}", f"{i % 3:08d}", float(r.integers(40, 43)), float(r.uniform(-110, -106) if i % 2 else -108), float(r.integers(20, 90)), float(r.normal(3, 0.3)), float(r.uniform(0.001, 0.01))) for i in range(90)]
    return spark.createDataFrame(rows, "site string, code string, lat double, lon double, area double, log_flow double, variance double").withColumn("key", F.col("code"))


def test_pairs_of_a_small_table_are_made_by_many_tasks(spark, keyed):
    from headwater.operators import transfer

    made = transfer.keyed_transfer_pairs(keyed, 0.7)
    assert made.select(F.spark_partition_id()).distinct().count() > 20
    k = keyed.select("site", "key")
    connections = k.join(k.withColumnRenamed("site", "other"), "key").filter("site < other")
    pairs = transfer.transfer_pairs(keyed, connections, 0.7)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, pairs.collect())) and made.count() == 90 * 29
    triples = sorted((r.receiver, r.donor1, r.donor2, round(r.product, 9)) for r in transfer.keyed_transfer_triples(keyed, 0.7).collect())
    assert triples == sorted((r.receiver, r.donor1, r.donor2, round(r.product, 9)) for r in transfer.transfer_triples(pairs).collect())


def test_donor_correlation_of_pairs_is_that_of_their_triples(spark, keyed):
    from headwater.operators import transfer

    p = transfer.keyed_transfer_pairs(keyed, 0.7)
    a, b = p.alias("a"), p.alias("b")
    triples = a.join(b, (F.col("a.receiver") == F.col("b.receiver")) & (F.col("a.donor") < F.col("b.donor"))).select((F.col("a.error") * F.col("b.error")).alias("product"), F.lit(0.001).alias("known"), F.col("a.log_ar").alias("log_ar1"), F.col("b.log_ar").alias("log_ar2"))
    want, got = dimensions.donor_correlation(triples, (0.01, 0.02)).first(), dimensions.donor_correlation_of_pairs(p, 0.001, (0.01, 0.02)).first()
    assert got.n == want.n == 90 * 29 * 14 and got.correlation == pytest.approx(want.correlation, abs=1e-9)


def test_nearest_donor_is_that_of_all_pairs(spark, keyed):
    from headwater.operators import transfer

    a, b = keyed, keyed.select("key", *(F.col(c).alias(c + "2") for c in ("site", "lat", "lon", "area", "log_flow")))
    pairs = a.join(b, "key").filter("site <> site2 AND area / area2 BETWEEN 0.5 AND 1.5").withColumn("km", transfer.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).filter("km <= 60")
    want = {r.site: (r.x.km, r.x.site2) for r in pairs.groupBy("site").agg(F.min(F.struct("km", "site2")).alias("x")).collect()}
    got = {r.site: (r.km, r.donor) for r in transfer.nearest_donor(keyed, 0.7, 8, max_km=60.0).collect()}
    assert got == want and 60 < len(want) and {km == 0 for km, _ in want.values()} == {True, False}


def test_bins_are_cut_within_equal_ratios(spark):
    from headwater.operators import transfer

    rows = spark.createDataFrame([(f"d{i:02d}", "r", float(i), 0.0, 0.1 if i < 9 else 0.2) for i in range(11)], "donor string, receiver string, error double, known double, log_ar double")
    got = {r.bin: (r.lo, r.hi, r.excess, r.n) for r in transfer.by_ratio(rows, 4).collect()}
    assert got == {1: (0.1, 0.1, 5 / 3, 3), 2: (0.1, 0.1, 50 / 3, 3), 3: (0.1, 0.1, 149 / 3, 3), 4: (0.2, 0.2, 181 / 2, 2)}


def test_blends_and_dissimilarity_by_sums(spark, keyed):
    from headwater.operators import estimators, transfer

    p = transfer.keyed_transfer_pairs(keyed, 0.7)
    frame = p.toPandas()
    got = {r.target: r for r in estimators.blend(p.select(F.col("receiver").alias("target"), F.col("error").alias("estimate"), F.col("known").alias("variance")), 0.3).collect()}
    for site, mine in frame.groupby("receiver"):
        sd = np.sqrt(mine["known"].to_numpy())
        w = np.linalg.solve(np.outer(sd, sd) * np.where(np.eye(29, dtype=bool), 1.0, 0.3), np.ones(29))
        assert (got[site].estimate, got[site].variance, got[site].n) == (pytest.approx(w @ mine["error"] / w.sum()), pytest.approx(1 / w.sum()), 29)
    twice = p.unionAll(p).withColumn("group", F.lit("a"))
    fit = estimators.fit_dissimilarity(twice).first()
    assert (fit.nugget, fit.slope) == pytest.approx(estimators.dissimilarity(frame), abs=1e-9) and fit.n == 2 * len(frame)
    w = 1 / np.maximum(frame["known"] + fit.nugget + fit.slope * frame["log_ar"], 1e-9)
    slopes = [(w * w * (frame["error"] ** 2 - frame["known"] - fit.nugget - fit.slope * frame["log_ar"]) * x).sum() for x in (1.0, frame["log_ar"])]
    assert all(abs(g) < 1e-3 if c > 0 else g < 1e-3 for g, c in zip(slopes, (fit.nugget, fit.slope)))


def test_gages_left_out_are_dealt_to_tasks(spark, keyed):
    from headwater.operators import estimators, transfer

    own = keyed.select(F.lit("a").alias("group"), "site", "log_flow", "variance", F.lit(3.0).alias("regression"), F.lit(0.05).alias("regression_variance"))
    out = estimators.leave_one_out(transfer.keyed_transfer_pairs(keyed, 0.7).withColumn("group", F.lit("a")), own, 0.1)
    assert out.select("site", F.spark_partition_id().alias("p")).distinct().count() == 90
    assert "share" in out._jdf.queryExecution().executedPlan().toString()
