"""Hand-written edge frames: boundaries, ties, nulls."""

from datetime import date

from pyspark.sql import functions as F

from leadloom.functions import alike, dates, text
from leadloom.operators import aggregates, evaluation, features, filters, joins, resolution, tiers, windows
from leadloom.sources import tables


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_month_boundaries(spark):
    d = lambda s: F.lit(s).cast("date")
    assert one(spark, dates.month_diff(d("2024-03-01"), d("2024-01-31"))) == 2
    assert one(spark, dates.month_diff(d("2024-02-29"), d("2024-02-01"))) == 0
    assert one(spark, dates.shift(d("2024-03-31"), -1, "month")) == date(2024, 2, 29)
    assert one(spark, dates.parse_period(F.lit("2024-13"))) is None


def test_dirty_ids(spark):
    got = [one(spark, text.digits_id(F.lit(x))) for x in ("CRD-12 3", "", "abc", "9" * 30)]
    assert got == [123, None, None, None]


def test_interval_ends(spark):
    left = spark.createDataFrame([(1, 7, date(2020, 5, 1))], "lead_id long, person_id long, contacted date")
    rows = [(7, 1, 10, date(2020, 1, 1), date(2020, 5, 1)), (7, 2, 11, date(2020, 1, 1), date(2020, 5, 1)), (7, 3, 12, date(2020, 5, 2), None)]
    hist = spark.createDataFrame(rows, "person_id long, spell_id long, firm_id long, start_date date, end_date date")
    find = lambda **o: joins.active_interval(left, hist, "person_id", "contacted", "lead_id", tiebreak="spell_id", **o).first().firm_id
    assert find() == 11 and find(end_inclusive=False) is None and find(end_inclusive=False, allow_gap=True) == 11


def test_asof_on_the_day(spark):
    left = spark.createDataFrame([(1, date(2020, 5, 1)), (2, date(2020, 5, 1))], "k long, d date")
    right = spark.createDataFrame([(1, date(2020, 5, 1), 5), (1, date(2020, 4, 1), 4), (1, date(2020, 5, 2), 9)], "k long, m date, v int")
    find = lambda strict: {r.k: r.v for r in joins.asof_join(left, right, "k", "d", "m", strict=strict).collect()}
    assert find(False) == {1: 5, 2: None} and find(True) == {1: 4, 2: None}


def test_targets(spark):
    c, n = date(2020, 1, 1), 30
    rows = [(1, c, date(2020, 1, 31)), (2, c, date(2020, 2, 1)), (3, date(2020, 12, 20), None), (4, c, None), (5, c, date(2019, 12, 1))]
    df = spark.createDataFrame(rows, "i int, contacted date, converted date")
    get = lambda late: [r.t for r in df.select("i", features.target(date(2020, 12, 31), n, late).alias("t")).orderBy("i").collect()]
    assert get("negative") == [1, 0, None, 0, 0] and get("null") == [1, None, None, 0, 0]


def test_nobody_counts_as_one(spark):
    leads = spark.createDataFrame([(1, 7, date(2020, 1, 1))], "lead_id long, person_id long, contacted date")
    facts = spark.createDataFrame([], "person_id long, d date, kind string")
    got = features.dated_counts(leads, facts, kind="kind", kinds=["a"], fact_date="d", months=12, prefix="f").first()
    assert (got.f_count, got.f_0, got.f_recent) == (0, 0, 0)


def test_ranks_with_ties(spark):
    df = spark.createDataFrame([(i, 1.0 if i < 50 else float(i)) for i in range(100)] + [(100, None)], "i long, v double")
    got = {r.i: r.list_rank for r in windows.rank_all(df, "v", [F.col("i")]).collect()}
    assert [got[i] for i in range(101)] == list(range(1, 102))
    same = df.withColumn("v", F.lit(0.5))
    assert {r.percentile for r in windows.score_percentile(same, "v").collect()} == {0}
    assert evaluation.auc(same.withColumn("y", (F.col("i") % 2).cast("int")), "y", "v").first().auc_roc == 0.5
    assert evaluation.auc(same.withColumn("y", F.lit(0)), "y", "v").first().auc_roc is None


def test_nulls_in_exclusions(spark):
    df = spark.createDataFrame([(1, None), (2, "SALES"), (3, "OWNER")], "k long, title string")
    keys = spark.createDataFrame([(3,)], "k long")
    assert filters.exclude_titles(df, ["sales"]).count() == 2
    assert filters.exclude_titles(df, ["sales"], keep_null_title=False).count() == 1
    nulls = df.withColumn("k", F.when(F.col("k") > 1, F.col("k")))
    assert filters.exclude_keys(nulls, keys, "k").count() == 1 and filters.exclude_keys(nulls, keys, "k", null_aware=False).count() == 2


def test_first_tier_wins_and_quotas(spark):
    df = spark.createDataFrame([(1, 2, 8, -3, 5, 0, 1, 0, 0, 4)], "person_id long, tenure_years int, experience_years int, net_change int, headcount int, is_wirehouse int, is_cfp int, series_65_only int, is_high_value int, prior_firms int")
    assert tiers.assign_tier(df).first().tier == "TIER_1A_PRIME_MOVER_CFP"
    assert tiers.assign_tier(df.withColumn("tenure_years", F.lit(None).cast("int")).withColumn("prior_firms", F.lit(0))).first().tier == "TIER_3_MODERATE_BLEEDER"
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "i int, t string")
    assert {r.i for r in windows.tier_quota(rows, "t", {"a": 1, "b": 0, "d": 9}, [F.col("i")]).collect()} == {1}


def test_names(spark):
    df = spark.createDataFrame([(1, "*Acme & Co f/k/a Old Acme; d/b/a Shop One")], "id int, n string")
    got = resolution.parse_names(df, "n").first()
    assert (got.main_name, got.former_names, got.dbas) == ("Acme & Co", ["Old Acme"], ["Shop One"])
    assert one(spark, resolution.normalise(F.lit("A & B, LLC (see note 3)"), cleanup=True)) == "a and b llc"
    assert one(spark, resolution.base_name(F.lit("A-B, L.L.C."))) == "a b"
    left = spark.createDataFrame([("l", "firm", "Acme")], "id string, kind string, variant string")
    right = spark.createDataFrame([("r1", "ACME!"), ("r2", "acme")], "right_id string, right_name string")
    got = resolution.tier_match(left, right).first()
    assert (got.right_id, got.tier) == ("r1", "normalised")


def test_similarity_modes(spark):
    s = lambda a, b, m: one(spark, alike.similarity(F.lit(a), F.lit(b), m))
    long, short = "morgan stanley wealth management", "morgan stanley"
    assert s(short, long, "partial") == s(long, short, "partial") == 1.0 and s(short, long, "ratio") == 28 / 46
    assert s(short, long, "token_set") == 1.0 and s("a b", "c d", "token_set") < 1
    assert s("Morgan Stanley Wealth Management", "Wealth Management Morgan Stanley", "token_sort") == 1.0
    assert s("", "", "max") == 1.0 and s("", "x", "partial") == 0.0 and s(None, "x", "max") == s(None, "x", "ratio") == 0.0


def test_match_over_variants(spark):
    """The best of the main, former and trading names, and which it was; of equals the smaller key."""
    rows = [(1, "Current Name LLC", "Old Name Inc, Previous Name Corp", "DBA Name"), (2, "Unknown Firm Name", None, "Known DBA Name"), (3, "Nothing Alike", "", "")]
    found = resolution.column_variants(spark.createDataFrame(rows, "id int, firm string, former string, dbas string"), "id", "firm", "former", "dbas")
    assert {(r.kind, r.variant) for r in found.where("id = 1").collect()} == {("firm", "Current Name LLC"), ("former", "Old Name Inc"), ("former", "Previous Name Corp"), ("dba", "DBA Name")}
    right = spark.createDataFrame([("r2", "Known DBA Name LLC"), ("r1", "Known DBA Name Inc"), ("r3", "Zyx")], "right_id string, right_name string")
    got = {r.id: r for r in resolution.tier_match(found, right).collect()}
    assert (got[2].right_id, got[2].tier, got[2].matched_on) == ("r1", "base", "dba")
    assert (got[3].right_id, got[3].tier, got[3].confidence) == (None, "none", 0.0)
    over = spark.createDataFrame([(3, "by hand")], "id int, right_id string")
    final = {r.id: (r.right_id, r.tier, r.confidence, r.needs_review) for r in resolution.with_overrides(resolution.tier_match(found, right), over).collect()}
    assert final[3] == ("by hand", "manual", 1.0, False) and final[2][3] is False


def test_fuzzy_ties_take_the_smaller_key_and_swapped_tokens_meet(spark):
    left = spark.createDataFrame([("l", "firm", "gear hot")], "id string, kind string, variant string")
    right = spark.createDataFrame([("r9", "hot gear"), ("r3", "Hot Gear"), ("r1", "hot pan")], "right_id string, right_name string")
    got = resolution.tier_match(left, right).first()
    assert (got.right_id, got.tier, got.confidence) == ("r3", "fuzzy", 1.0)


def test_blocks(spark):
    left = spark.createDataFrame([("a", "apple pie"), ("b", "zeta one"), ("c", "customer 000000014")], "id string, name string")
    names = ["apple inc", "banana corp", "apricot llc", "customer 000000014x", *[f"customer {i:09d}y" for i in range(100, 160)]]
    right = spark.createDataFrame([(f"r{i}", n) for i, n in enumerate(names)], "right_id string, right_name string")
    pairs = lambda s: {(r.id, r.right_id) for r in resolution.blocked_pairs(left, right, "name", "right_name", s).collect()}
    assert {("a", "r0"), ("a", "r2")} <= pairs("first") and ("a", "r2") not in pairs("token")
    similar = pairs("similar")
    assert ("c", "r3") in similar and not any(x != "c" for x, _ in similar)
    hybrid = pairs("hybrid")
    assert ("a", "r2") in hybrid and not any(x == "b" for x, _ in hybrid)


def test_numbers_and_sums_in_parts(spark):
    """One order over all shuffle partitions: ties are split, groups and nulls keep their place."""
    rows = [(i, None if i % 50 == 0 else i % 7, f"g{i % 3}" if i % 11 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "i long, v int, g string")
    got = windows.positioned(df, "v", [F.col("i")]).collect()
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    assert {r.i: r._pos for r in got} == {r[0]: k + 1 for k, r in enumerate(order)} and {r._n for r in got} == {1000}
    got = windows.numbered(df, [F.col("i").desc()], "k", groups=["g"], total="n").collect()
    for g in ("g0", "g1", "g2", None):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.k)
        assert [r.k for r in mine] == list(range(1, len(mine) + 1)) and [r.i for r in mine] == sorted((r.i for r in mine), reverse=True)
    quarters = windows.quantile_values(df.withColumn("w", F.col("i") * 1.5), "w", {"q": 0.25, "m": 0.5}, ["g"]).collect()
    want = {r.g: (r.q, r.m) for r in df.groupBy("g").agg(F.percentile(F.col("i") * 1.5, F.lit(0.25)).alias("q"), F.percentile(F.col("i") * 1.5, F.lit(0.5)).alias("m")).collect()}
    assert {r.g: (r.q, r.m) for r in quarters} == want


def test_headcount_of_overlapping_spells(spark):
    d = lambda m, day=1: date(2020, m, day)
    rows = [(1, 9, d(1), d(3)), (1, 9, d(2), d(5)), (2, 9, d(4), None), (3, 9, d(5, 2), d(5, 2)), (None, 9, d(1), None)]
    hist = spark.createDataFrame(rows, "person_id long, firm_id long, start_date date, end_date date")
    at = spark.createDataFrame([(9, x) for x in (date(2019, 1, 1), d(1), d(4), d(5), d(5, 2), d(6))] + [(8, d(1))], "firm_id long, at_date date")
    got = {(r.firm_id, r.at_date): r.headcount for r in aggregates.headcount_at(hist, at).collect()}
    assert got == {(9, date(2019, 1, 1)): 0, (9, d(1)): 1, (9, d(4)): 2, (9, d(5)): 2, (9, d(5, 2)): 2, (9, d(6)): 1, (8, d(1)): 0}


def test_fisher_on_large_counts(spark):
    rows = [("a", 1, 600_000), ("a", 0, 400_000), ("b", 1, 599_000), ("b", 0, 401_000)]
    counts = spark.createDataFrame(rows, "g string, y int, n long")
    df = counts.select("g", "y", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_")).drop("_")
    got = evaluation.fisher(df, "g", "y", "a", "b").first()
    assert 0.07 < got.p_value < 0.08  # the normal approximation gives 0.0745
    assert evaluation.fisher(df, "g", "y", "b", "a").first().p_value > 0.92


def test_changes(spark):
    cols = "key int, name string, brand string"
    old = spark.createDataFrame([(1, "a", None), (2, "b", ""), (3, "c", "x")], cols)
    new = spark.createDataFrame([(1, "a", None), (2, "b", None), (4, "d", "y")], cols)
    got = {(r.key, r.change) for r in resolution.diff(old, new, "key", "name", ["brand"]).collect()}
    assert got == {(1, "MATCHED"), (2, "MATCHED"), (3, "WITHDREW"), (4, "JOINED")}


def test_flow_counts_twelve_month_starts(spark):
    hist = spark.createDataFrame([(1, 9, date(2020, 1, 1), date(2020, 1, 2))], "person_id long, firm_id long, start_date date, end_date date")
    got = aggregates.rolling_flow(hist, date(2019, 1, 1), date(2022, 1, 1)).collect()
    assert sorted(r.month for r in got if r.arrivals)[0] == date(2020, 1, 1) and sum(r.arrivals for r in got) == 12
    assert sorted(r.month for r in got if r.departures)[0] == date(2020, 2, 1) and sum(r.departures for r in got) == 12


def test_quantile_sketches_merge_in_any_order(spark):
    df = spark.range(200_000).select((F.col("id") % 24).alias("month"), F.exp(F.randn(5) * 3).alias("v"))
    months = aggregates.quantile_sketches(df, "v", ["month"]).cache()
    probs = {"q1": 0.01, "q50": 0.5, "q99": 0.99}
    for order in (F.asc("month"), F.desc("month")):
        got = aggregates.sketch_quantiles(aggregates.merged_sketches(months.repartition(5).sortWithinPartitions(order)), probs).first()
        ranks = df.agg(*[F.avg((F.col("v") <= got[n]).cast("int")).alias(n) for n in probs]).first()
        assert got.n == 200_000 and all(abs(ranks[n] - p) < 0.01 for n, p in probs.items())
    assert aggregates.sketch_quantiles(months, probs).count() == 24


def test_long_lists_are_several_files(spark, tmp_path):
    df = spark.range(100).withColumn("v", -F.col("id"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so short a list is one partition
    try:
        for most in (1000, 99):
            tables.export_csv(df, ["id", "v"], str(tmp_path / "out"), ["v"], most=most)
            found = sorted((tmp_path / "out").glob("part-*.csv"))
            assert (len(found) == 1) == (most == 1000)
            assert [x.split(",")[0] for f in found for x in f.read_text().splitlines()[1:]] == [str(i) for i in reversed(range(100))]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
