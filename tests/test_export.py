"""The chart strategy from research results: crossover and rule scripts, their summaries, and the command line's mode."""

import json

import pytest

from barsmith import cli
from barsmith.export import script, strategy

WEIGHTS = [{"category": "trend", "weight": 60.0}, {"category": "trend", "weight": 15.5}, {"category": "time", "weight": 24.5}, {"category": "vwap", "weight": 0.0}, {"weight": 1.0}]


def test_alpha_and_filters():
    assert strategy.category_weights(WEIGHTS) == {"trend": 75.5, "time": 24.5, "vwap": 0.0, "unknown": 1.0}
    raw, total, _ = strategy.score_lines(WEIGHTS)
    assert raw == "alphaRaw = (close > ema200 ? 75.5 : 0.0) + (hour >= 9 and hour <= 14 ? 24.5 : 0.0)" and total == "alphaTotal = 100.0"
    assert strategy.score_lines([])[:2] == ["alphaRaw = 0.0", "alphaTotal = 1.0"]
    lines = strategy.filter_lines({"hour": "09", "rsi_bucket": "50-60", "odd": "x"})
    assert lines == [strategy.FILTERS["hour"], "// filter odd = x"] and strategy.filter_lines({}) == ["// no further filters"]


def test_crossover_from_reports(tmp_path):
    files = {"best_parameters": [{"symbol": "b", "fast_ema": 9, "slow_ema": 21}, {"symbol": "a", "fast_ema": 20, "slow_ema": 50}], "best": [{"symbol": "a", "feature": "hour", "bucket": "09"}], "weights": [dict(w, symbol="a") for w in WEIGHTS]}
    for name, rows in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    argv = ["--mode", "pine", "--out", str(tmp_path / "out"), "--parameters", str(tmp_path / "best_parameters.json"), "--best", str(tmp_path / "best.json"), "--weights", str(tmp_path / "weights.json")]
    assert cli.main(argv) == 0
    text = (tmp_path / "out" / "strategy.pine").read_text()
    about = json.loads((tmp_path / "out" / "strategy_summary.json").read_text())
    assert text.startswith("//@version=5\n") and "fastLength = input.int(20," in text and "slowLength = input.int(50," in text and "ta.crossunder(fastEma, slowEma)" in text
    assert about["ema_parameters"] == {"fast": 20, "slow": 50} and about["context_filters"] == ["hour"] and about["alpha_weights"]["trend"] == 75.5 and len(about["input_files_used"]) == 3
    assert cli.main([*argv, "--symbol", "b"]) == 0 and "input.int(9," in (tmp_path / "out" / "strategy.pine").read_text()
    with pytest.raises(FileNotFoundError, match="optimize"):
        strategy.export(str(tmp_path), parameters=str(tmp_path / "none.json"))


def test_rule_from_ranking(tmp_path):
    ranking = [{"rank": 2, "features": "rsi", "buckets": "q0"}, {"rank": 1, "features": "rsi|ema_20", "buckets": "q1|q0", "win_rate": 62.5, "composite_score": None, "signal_frequency": 40}]
    (tmp_path / "ranking.json").write_text(json.dumps(ranking))
    (tmp_path / "quantiles.json").write_text(json.dumps({"_meta": {"bins": 2}, "rsi": {"q0": [0, 30], "q1": [30, 100]}, "ema_20": {"q0": [1, 2], "q1": [2, 3]}}))
    files = {"patterns": str(tmp_path / "ranking.json"), "quantiles": str(tmp_path / "quantiles.json")}
    path, summary = strategy.export(str(tmp_path), **files)
    text = path.read_text()
    assert "signal = (rsiValue >= 30.0 and rsiValue <= 100.0) and (ema20 >= 1.0 and ema20 < 2.0)" in text and "researchScore = 0.0" in text
    assert "// win rate: 62.5%" in text and "// expectancy: n/a" in text and "// signal frequency: 40" in text and text.count("ta.rsi(") == 1
    names = [line.split(" = ")[0] for line in text.splitlines() if " = " in line and not line.startswith((" ", "//"))]
    assert len(names) == len(set(names))
    assert json.loads(summary.read_text())["signal_pattern"]["conditions"] == ["rsi == q1", "ema_20 == q0"]
    with pytest.raises(ValueError, match="both"):
        strategy.export(str(tmp_path), patterns=files["patterns"])


def test_translations_can_be_added(monkeypatch):
    monkeypatch.setattr(script, "INDICATORS", dict(script.INDICATORS))
    script.register("spread", "spreadValue", ("spreadValue = high - low",))
    assert script.indicator("spread") == ("spreadValue", ("spreadValue = high - low",))
    for taken in ("spread", "rsi", "ema_9"):
        with pytest.raises(ValueError):
            script.register(taken, "x")
