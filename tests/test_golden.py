"""A small marketing file written by this test, cleaned, against independent pandas expressions."""
import numpy as np
import pandas as pd
import pytest

from adloom.operators import reports as R
from adloom.plans.pipeline import CleanOptions, clean_dataset
from adloom.sources.csv import read_csv

CAMPAIGNS = ["US_Search_Brand", "UK_RTG_Display", "DE_Email_News", "FR_Social_RMKT", "NL_Video", "CA_Bot"]


def own_rows(n=48, seed=21):
    rng = np.random.default_rng(seed)
    dates = pd.date_range("2024-03-01", periods=n, freq="18h").strftime("%Y-%m-%d %H:%M:%S")
    return pd.DataFrame({
        "Date": dates, "Campaign Name": rng.choice(CAMPAIGNS, n), "impressions": rng.integers(0, 900, n) * 10,
        "clicks": rng.integers(0, 400, n), "conversions": rng.integers(0, 4, n), "spend": rng.integers(0, 90, n).astype(float),
        "price": rng.integers(1, 40, n) / 2, "quantity": rng.integers(0, 9, n)})


@pytest.fixture(scope="module")
def golden(spark, tmp_path_factory):
    raw = own_rows()
    path = tmp_path_factory.mktemp("golden") / "own.csv"
    raw.sample(frac=1, random_state=1).to_csv(path, index=False)
    df, _ = read_csv(spark, str(path))
    res = clean_dataset(df, CleanOptions())
    p = raw.rename(columns={"Date": "date", "Campaign Name": "campaign_name"}).assign(date=lambda x: pd.to_datetime(x["date"]))
    p["revenue"] = p.price * p.quantity
    den = {c: p[c].replace(0, 1) for c in ("impressions", "clicks", "conversions", "spend", "revenue")}
    p["ctr"], p["conversion_rate"], p["roas"] = p.clicks / den["impressions"], p.conversions / den["clicks"], p.revenue / den["spend"]
    p["cpa"], p["cpc"], p["cpm"] = p.spend / den["conversions"], p.spend / den["clicks"], p.spend / den["impressions"] * 1000
    p["profit"] = p.revenue - p.spend
    p["profit_margin"] = p.profit / den["revenue"]
    return res, res.df.toPandas().sort_values("date").reset_index(drop=True), p


def test_row_features(golden):
    _, got, want = golden
    for c in ("revenue", "ctr", "conversion_rate", "roas", "cpa", "cpc", "cpm", "profit", "profit_margin"):
        assert got[c].tolist() == pytest.approx(want[c].tolist()), c
    assert got["is_suspicious_traffic"].tolist() == ((want.clicks > 200) & (want.conversions == 0)).tolist()
    assert got["is_ctr_anomaly"].tolist() == (want.ctr > 1).tolist()
    assert got["day_of_week"].tolist() == want.date.dt.day_name().tolist()
    assert got["month"].tolist() == want.date.dt.strftime("%Y-%m").tolist()
    assert got["week_number"].tolist() == want.date.dt.isocalendar().week.tolist()
    assert got["days_since_start"].tolist() == (want.date - want.date.min()).dt.days.tolist()
    low = want.campaign_name.str.lower()
    assert got["is_retargeting"].tolist() == low.str.contains("retargeting|rmkt|rtg").tolist()
    assert got["channel"].tolist() == low.str.extract("(search|display|social|email|video)")[0].fillna("other").str.title().tolist()
    assert set(got["data_quality_score"]) == {100.0}


def test_statistics_and_windows(golden):
    _, got, want = golden
    for c in ("clicks", "spend", "price"):
        z = ((want[c] - want[c].mean()) / want[c].std()).round(4)
        assert got[f"z_{c}"].tolist() == pytest.approx(z.tolist(), abs=1.1e-4)
    for c in ("revenue", "clicks", "conversions", "roas"):
        assert got[f"{c}_percentile"].tolist() == pytest.approx((want[c].rank(pct=True).round(4) * 100).tolist())
        for k in (3, 7):
            ma = want[c].rolling(k, min_periods=1).mean().round(4)
            assert got[f"{c}_ma{k}"].tolist() == pytest.approx(ma.tolist(), abs=1.1e-4)
    for c in ("revenue", "clicks", "conversions", "spend"):
        assert got[f"{c}_cumulative"].tolist() == pytest.approx(want[c].cumsum().tolist())
    tiers = pd.qcut(want.roas, 4, labels=["Poor", "Below Avg", "Above Avg", "Excellent"])
    assert got["spend_efficiency_tier"].tolist() == tiers.tolist()
    parts = [(want[c] - want[c].min()) / (want[c].max() - want[c].min()) for c in ("ctr", "conversion_rate", "roas")]
    assert got["engagement_score"].tolist() == pytest.approx((sum(parts) / 3 * 100).round(2).tolist(), abs=0.011)


def test_reports(golden):
    res, _, want = golden
    df = res.df
    daily = want.groupby(want.date.dt.strftime("%Y-%m-%d")).revenue.sum()
    assert [(r["date_label"], r["revenue"]) for r in R.revenue_by_date(df).collect()] == [(d, pytest.approx(v)) for d, v in daily.items()]
    best = sorted(daily.items(), key=lambda x: (-x[1], x[0]))[:5]
    assert [(r["date_label"], r["revenue"]) for r in R.top_days(df, 5).collect()] == [(d, pytest.approx(v)) for d, v in best]
    assert [r["date_label"] for r in R.top_days(df, 5, ascending=True).collect()] == [d for d, _ in best[::-1]]
    scale = 100 if want.ctr.max() < 1 else 1
    assert [r["count"] for r in R.ctr_histogram(df).orderBy("bin").collect()] == np.histogram(want.ctr * scale, bins=20)[0].tolist()
    months = want.groupby(want.date.dt.strftime("%Y-%m")).revenue.sum()
    assert [r["revenue"] for r in R.monthly_revenue(df).collect()] == pytest.approx(months.tolist())
    series = R.trend(df, ["revenue"], [], order_cols=res.order_cols).collect()
    assert [(r["row_index"], r["revenue"]) for r in series] == [(i, pytest.approx(v)) for i, v in enumerate(want.revenue)]
