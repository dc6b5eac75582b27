import pytest
from pyspark.sql import functions as F

from lodestone import semantics as S
from lodestone.functions import dates, geo, text

STATES = [(None, None), (0, 7), (-1, 8), (5, 0), (5, 3), (5, 4), (5, 5), (5, 9), (None, 0), (5, None), (0, 0), (-1, 0)]


@pytest.fixture(scope="module")
def states(spark):
    return spark.createDataFrame(STATES, "q long, uid long")


def test_match_states(states):
    rows = states.select("q", "uid", S.match_state(True).alias("u"), S.match_state(False, True).alias("p"), S.match_state(False, False, True).alias("f"), S.match_state().alias("any")).collect()
    for r in rows:
        full = r.q is not None and r.q > 0 and r.uid is not None and r.uid > 0
        assert bool(r.u) == (r.q is None) and bool(r.f) == full and bool(r.p) == (r.q is not None and r.q > 0 and r.uid == 0) and r.any


def test_buckets(states):
    want = {(None, None): "noq", (0, 7): "na", (-1, 8): "nowd", (5, 0): "autoq", (5, 4): "manual", (None, 0): "noq", (5, None): "noq", (0, 0): "autoq", (-1, 0): "autoq"}
    got = {(r.q, r.uid): r.b for r in states.withColumn("b", S.bucket()).collect()}
    assert all(got[k] == v for k, v in want.items())


def test_guard_lets_people_write_and_algorithms_only_open_entries(states):
    rows = states.select("q", "uid", S.may_write(F.lit(4), F.lit(9)).alias("algo"), S.may_write(F.lit(9), F.lit(9)).alias("person"), S.may_write(F.lit(9), F.lit(5)).alias("same")).collect()
    for r in rows:
        assert bool(r.algo) == (r.q is None or (r.q > 0 and r.uid == 0)) and r.person
        assert bool(r.same) == (not (r.q == 5 and r.uid == 9))


def column(spark, f, *values):
    width = len(values[0]) if isinstance(values[0], tuple) else 1
    rows = [v if width > 1 else (v,) for v in values]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(width)))
    return [r[0] for r in df.select(f(*[F.col(f"c{i}") for i in range(width)])).collect()]


def test_names(spark):
    got = column(spark, text.simplify_name, "Sir Dr. Jane Middle Doe", "Prince Sir Baron Graf Jane Doe", "Jane Doe (1900-1950)", "Jane Doe, Jr.", "Plato", "Jane Doe PhD")
    assert got == ["Jane Doe", "Jane Doe", "Jane Doe", "Jane Doe", "Plato", "Jane Doe"]
    assert column(spark, text.sanitize_name, "Jane   Doe (x)", "A & B", "Sir Jane") == ["Jane Doe", "A B", "Jane"]
    assert column(spark, text.has_initials, "J. Doe", "Jane") == [True, False]


def test_text(spark):
    assert column(spark, text.clean_html, "<p>a&nbsp;&amp; <b>b</b></p>", None, "x") == ["a & b", None, "x"]
    assert column(spark, text.description_check, ("born 1900, died 1950", "1950 or 1900"), ("born 1900", "1901"), ("no", "number"), ("a", "a")) == [True, False, False, True]
    assert column(spark, S.entry_type, "Person ", "q5", "Q5", "q12", "thing", "") == ["Q5", "Q5", "Q5", "Q12", "", ""]
    assert column(spark, text.rewrite_taxon_name, "Aus bus ssp. cus", "× Aus bus", "Aus var bus") == ["Aus bus subsp. cus", "×Aus bus", "Aus var. bus"]
    assert column(spark, text.scrub_cell, "a\tb\r\nc d", None) == ["a b  c d", ""]
    assert column(spark, text.formatter_to_regex, "http://x.org/a?id=$1") == ["^https?://x\\.org/a\\?id=(.+?)$"]


def test_dates(spark):
    assert column(spark, dates.canonical, "1920", "1920-3", "1920-03-07", "-500") == ["1920", "1920-03", "1920-03-07", "-500"]
    assert column(spark, lambda c: dates.parse(c).isNull(), "1920-13", "1920-01-32", "x", "", "1920-02-31") == [True, True, True, True, False]
    assert column(spark, dates.precision, "1920", "1920-03", "1920-03-07", "no") == [9, 10, 11, None]
    assert column(spark, dates.wire_time, "1920", "1920-03", "-500-01-02") == ["+1920-00-00T00:00:00Z", "+1920-03-00T00:00:00Z", "-500-01-02T00:00:00Z"]
    assert column(spark, dates.parse_text, "1900", "7.3.1920", "3. 1920", "7 March 1920", "März 1920", "May 7, 1920", " some day", "15 août 900") == ["1900", "1920-03-07", "1920-03", "1920-03-07", "1920-03", "1920-05-07", "some day", "0900-08-15"]
    assert column(spark, dates.month_code, "Gennaio", "okt", "x") == ["jan", "oct", "x"]
    assert column(spark, text.safe_url, "http://x/a b|c%20[d]") == ["http://x/a%20b%7Cc%20%5Bd%5D"]
    assert column(spark, dates.plausible_life, ("1900", "1950"), ("1950", "1900"), ("1900", "1900"), ("1800", "1950"), ("2060", ""), ("1900", "")) == [True, False, False, False, False, True]


def test_points(spark):
    got = column(spark, geo.parse_point, "POINT(1.5 -2.5)", "@51.5,0.1", "1.5/-2.5", "nowhere")
    assert [tuple(p) if p else None for p in got] == [(1.5, -2.5), (51.5, 0.1), (1.5, -2.5), None]
    assert column(spark, geo.parse_distance, "500m", "2km", "x") == [500.0, 2000.0, None]


def test_radius_join_over_poles_and_date_line(spark):
    import math
    import random

    rng = random.Random(3)
    places = [(k, rng.choice([89.7, -89.8, rng.uniform(-90, 90)]), rng.choice([179.9, -179.9, rng.uniform(-180, 180)])) for k in range(150)]
    df = spark.createDataFrame(places, "id long, lat double, lon double")

    def metres(a, b):
        x = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * geo.EARTH_METRES * math.asin(math.sqrt(min(1, x)))

    want = {(a[0], b[0]) for a in places for b in places if metres(a, b) <= 300_000}
    assert {(r.id, r.other_id) for r in geo.within(df, df.withColumnRenamed("id", "other_id"), 300_000).collect()} == want
