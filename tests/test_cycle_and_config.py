"""Configuration, recorded calls and the whole cycle."""

import json

import pytest
from pyspark.sql import functions as F

from quern.operators import state
from quern.plans import cycle
from quern.sources import calls, config

LISTING = "source string, external_id string, title string, description string, url string, price_czk int, published_at timestamp, first_seen_at timestamp, last_seen_at timestamp"


def listings(spark, rows):
    at = F.lit("2026-07-19 11:00:00").cast("timestamp")
    df = spark.createDataFrame(rows, "source string, external_id string, title string, price_czk int, age int")
    return df.select("source", "external_id", "title", F.lit("").alias("description"), F.concat(F.lit("u"), "external_id").alias("url"), "price_czk", (at - F.make_dt_interval(hours="age")).alias("published_at"), at.alias("first_seen_at"), at.alias("last_seen_at"))


def test_config(tmp_path):
    f = tmp_path / "c.json"
    f.write_text(json.dumps({"poll_seconds": 420, "unknown": 1, "sources": [{"name": "a", "kind": "rss", "path": "x", "required": ["bike"]}, {"name": "b", "kind": "api", "path": "y"}]}))
    c = config.load(f, {"QUERN_HOT_PROFIT": "5000"})
    assert c.hot_profit == 5000 and [s.name for s in c.usable_sources()] == ["a"] and c.sources[0].required == ("bike",)
    with pytest.raises(ValueError, match="poll_seconds"):
        config.load(f, {"QUERN_POLL_SECONDS": "1"})
    (tmp_path / ".env").write_text("# c\nA='1'\nB=2\n")
    assert config.read_env(tmp_path / ".env") == {"A": "1", "B": "2"}


def test_cycle(spark):
    rows = [("s", "1", "hot", 10001, 1), ("s", "1", "hot again", 10001, 2), ("s", "2", "old", 10001, 9), ("s", "3", "no price", None, 1), ("s", "4", "loss", 20000, 1), ("t", "5", "known", 5000, 1)]
    batch, before = listings(spark, rows), listings(spark, [("t", "5", "known", 6000, 30)])
    v = spark.createDataFrame([("s", k, 17000, 20000, 3, 2, 0, 0, 3, True, "high") for k in "1234"], "source string, external_id string, quick_price int, market_price int, exact int, close int, family int, component int, sources int, home boolean, confidence string")
    costs = spark.createDataFrame([("s", "1", 100.0, 50.0, 25.0)], "source string, external_id string, acquisition double, logistics double, platform double")
    out = cycle.run(batch, before, v, costs, config.Config(), F.lit("2026-07-19 12:00:00").cast("timestamp"))
    got = {r["external_id"]: r for r in out.scored.collect()}
    assert set(got) == {"1", "2", "3", "4"} and out.state.count() == 5
    assert (got["1"]["status"], got["1"]["final"], float(got["1"]["profit"])) == ("HOT", "sent", 5806.4)
    assert got["2"]["final"] == "expired" and got["3"]["status"] == "MANUAL_REVIEW" and got["4"]["status"] == "REJECT"
    assert {r["external_id"] for r in out.selected.collect()} == {"1", "3"}
    assert out.funnel.first()["sent"] == 2
    assert out.state.where("external_id = '5'").first()["price_czk"] == 5000


def test_recorded_calls(spark, tmp_path):
    body = {"classification": {"is_bicycle": False, "listing_type": "Part", "confidence": 1.7}, "identity": {"brand": "X", "confidence": 0.4}, "condition": {}, "risk": {"flags": ["a", "a"], "severity": "weird"}, "evidence": [{"field": "risk", "excerpt": "e"}, {"field": "risk", "excerpt": ""}], "noise": 1}
    asked = []

    def ask(payload):
        asked.append(payload)
        if "bad" in payload:
            raise TimeoutError("slow")
        return {"model": "fallback", "body": body if "one" in payload else {"identity": {}}, "input_tokens": 1500, "cached_tokens": 5000, "output_tokens": 400}

    wanted = calls.requests(listings(spark, [("s", "1", "one", 1, 1), ("s", "2", "one", 1, 1), ("s", "3", "two", 1, 1), ("s", "4", "bad", 1, 1)]), "m", "v1")
    answers = state.Snapshots(spark, str(tmp_path / "a"))
    assert calls.run_calls(wanted, answers, ask, 10) == 3 and len(asked) == 3
    assert calls.run_calls(wanted, answers, ask, 10) == 1  # only the failure is asked again
    rows = {(r["status"], r["error"]): r for r in calls.validated(answers.read()).collect()}
    good = rows[("AI_OK", "")]
    assert (good["listing_type"], good["confidence"], good["brand"], good["risk_flags"], good["severity"], len(good["evidence"])) == ("part", 1.0, None, ["a"], "unknown", 1)
    assert ("AI_FAILED", "missing: classification, condition, risk") in rows
    checked = calls.validated(answers.read())
    assert checked.where(calls.non_bicycle(checked)).count() == 1
    spent = calls.call_costs(answers.read(), (0.2, 0.02, 1.2)).agg(F.sum("spent")).first()[0]
    assert spent == pytest.approx(2 * (1500 * 0.02 + 400 * 1.2) / 1e6)


def test_prompt_and_cli(tmp_path, capsys):
    d = tmp_path / "p" / "v1"
    d.mkdir(parents=True)
    (d / "system.md").write_text("do")
    (d / "schema.json").write_text("{}")
    assert calls.load_prompt(str(tmp_path), "p", "v1") == ("do", "{}")
    from quern.__main__ import main

    assert main(["list"]) == 0 and "valuation_part" in capsys.readouterr().out
