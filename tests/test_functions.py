import datetime
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewrack.functions import calendar, formula, measures, special, text
from tidewrack.operators import timeseries


def test_headers():
    assert text.clean_header("﻿ Organism Quantity ") == "organismquantity"
    assert text.clean_header("ｗｉｄｔｈ  a", keep_spaces=True) == "width a"
    assert text.clean_header("Señal", ascii_only=True) == "seal"


def test_texts(spark):
    df = spark.createDataFrame([("Navicula  sp. 3", "1.234,5", "x\x07 ﬁ"), ("Abra cf. alba", "n.a.", None), (None, "7", "  a\t b ")], "name string, num string, cell string")
    rows = df.select(
        text.clean_species(F.col("name")), text.normal_name(F.col("name")), text.slugify(F.col("name")), text.comma_number(F.col("num")), text.null_tokens(F.col("num")),
        text.clean_text(F.col("cell")), text.composite_key(["name", "num"]),
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("navicula", "naviculasp3", "navicula_sp_3", None, "1.234,5", "x fi", "Navicula  sp. 3.1.234,5"),
        ("abra", "abracfalba", "abra_cf_alba", None, None, None, "Abra cf. alba.n.a."),
        (None, None, None, 7.0, "7", "a b", "nan.7"),
    ]
    assert [r["num"] for r in text.decimal_column(df, "num").collect()] == [1234.5, None, 7.0]


def test_dates(spark):
    df = spark.createDataFrame([(2021, 2, 28), (2021, 2, 30), (None, 1, 1)], "y int, m int, d int")
    day = calendar.safe_date(F.col("y"), F.col("m"), F.col("d"))
    assert [r[0] for r in df.select(day).collect()] == [datetime.date(2021, 2, 28), None, None]
    assert df.select(calendar.interval_start(day, 8), calendar.month_bin(day, 2), calendar.day_of_year_date(F.lit(2020), F.lit(60))).first() == (datetime.date(2021, 2, 26), datetime.date(2021, 1, 1), datetime.date(2020, 2, 29))


def test_densities(spark):
    df = spark.createDataFrame([(10.0, 25.0, 0.5, 20.0, None, 5.0, None), (10.0, 25.0, 0.5, 20.0, 2.0, 5.0, 2.0), (10.0, None, None, None, None, 5.0, None), (10.0, 25.0, 0.5, 0.0, None, 0.0, None)], "q double, c double, f double, n double, t double, v double, k double")
    names = [F.col(x) for x in "qcfntv"]
    got = [tuple(r) for r in df.select(measures.counting_method(*names), measures.density(*names, F.col("k"))).collect()]
    fields = round(10 * 1000 * 12.5**2 / (20 * 0.25**2 * 5), 2)
    transects = round(round(10 / 2 * math.pi / 4 * 50 * 1000 / 5, 2) / 2, 2)
    assert got == [("random_fields", fields), ("transects", transects), ("whole_chamber", 2000.0), ("whole_chamber", None)]
    volumes = spark.createDataFrame([(v,) for v in (5.0, 5.1, 25.0, 50.0, 51.0, None)], "v double")
    assert [r[0] for r in volumes.select(measures.volume_coefficient(F.col("v"))).collect()] == [0.001979, 0.00365, 0.010555, 0.021703, 0.041598, None]


def test_formulas(spark):
    df = spark.createDataFrame([(2.0, 4.0)], "width double, `Length` double")
    value = lambda t: df.select(formula.formula(t, df.columns)).first()[0]
    assert value("pi/6 * width^2 * length") == pytest.approx(math.pi / 6 * 16)
    assert value("sqrt(length) - -width") == 4.0
    assert value("1 / (width - 2)") is None and value("log(width - 2)") is None
    assert value("1,5 * width") == 3.0
    for bad in ("height", "__import__('os')", "width.real", "width; 1", "max(width, 1)", "'a'", "width if 1 else 2", "width ^"):
        with pytest.raises(ValueError):
            formula.to_sql(bad, df.columns)
    rows = spark.createDataFrame([(1.0, "x*2"), (2.0, "x^2+1"), (3.0, "no"), (4.0, None), (5.0, "y")], "x double, f string")
    assert [r[0] for r in rows.select(formula.by_row("f", ["x*2", "x^2+1", "no", None, "y"], rows.columns)).collect()] == [2.0, 5.0, None, None, None]


def test_distribution_functions():
    # values from published tables
    assert special.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.f_upper(3.325835, 5, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.chi2_upper(18.307038, 10) == pytest.approx(0.05, abs=1e-7)
    assert special.normal_upper(1.959964) == pytest.approx(0.025, abs=1e-7)
    assert special.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert special.studentized_range_upper(3.877, 3, 10) == pytest.approx(0.05, abs=1e-3)


def test_columns_of_p_values(spark):
    df = spark.createDataFrame([(2.228139, 10.0), (None, 3.0)], "t double, df double")
    assert [None if r[0] is None else round(r[0], 5) for r in df.select(special.t_p_value("t", "df")).collect()] == [0.05, None]


def dense_whittaker(y, lam, p, rounds):
    d = np.diff(np.eye(len(y)), n=2, axis=0)
    w, z = np.ones(len(y)), y
    for _ in range(rounds):
        z = np.linalg.solve(np.diag(w) + lam * d.T @ d, w * y)
        w = np.where(y >= z, p, 1 - p)
    return z


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(0, 100), min_size=3, max_size=40), st.integers(1, 4))
def test_whittaker_is_the_dense_solution(values, rounds):
    y = np.array(values)
    assert np.allclose(timeseries.whittaker(y, 5.0, 0.1, rounds), dense_whittaker(y, 5.0, 0.1, rounds), atol=1e-6)


def test_sequential_correction():
    nan = float("nan")
    got = timeseries.correct_sequence(np.array([10, 12, 40, nan, 14, 50, 60.0]), 1.5)
    assert got.tolist() == [10, 12, 13, 13.5, 14, 14, 14]
    assert timeseries.correct_sequence(np.array([1, nan, 9.0]), None).tolist() == [1, 5, 9]


def test_shapiro_wilk():
    from tidewrack.operators.posthoc import autoregression, holm, shapiro_wilk

    # published example: weights of eleven men
    w, p = shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert w == pytest.approx(0.79, abs=0.005) and p == pytest.approx(0.0067, abs=0.002)
    assert shapiro_wilk(np.random.default_rng(1).normal(size=500))[1] > 0.05
    assert shapiro_wilk(np.random.default_rng(1).exponential(size=500))[1] < 1e-6
    assert holm([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06])
    b, ahead = autoregression(np.array([2.0**k for k in range(8)]), [1], 2)
    assert b == pytest.approx([0, 2], abs=1e-8) and ahead == pytest.approx([256, 512])
