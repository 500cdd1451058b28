"""Downloads that resume, open interest and the instrument master."""

import datetime as dt

import pytest

from barsmith.sources import broker


def test_download_resumes(spark, tmp_path):
    log, fail = str(tmp_path / "calls"), tmp_path / "fail"
    fail.touch()
    bad = str(fail)

    def client():
        def candles(symbol, interval, start, end):
            import datetime as dt
            import os

            with open(log, "a") as f:
                f.write(f"{symbol} {start}\n")
            if symbol == "B" and os.path.exists(bad):
                raise ValueError("refused")
            day = dt.datetime.combine(start, dt.time())
            return [{"date": day + dt.timedelta(days=k), "open": 1, "high": 2, "low": 0.5, "close": 1.5, "volume": 7, "oi": 3} for k in (0, 0, 1)]

        return candles

    spark.dataSource.register(broker.candle_source(client, "resumable"))
    ask = {"root": str(tmp_path / "data"), "symbols": ["A", "B"], "interval": "day", "start": "2000-01-01", "end": "2012-01-01", "source": "resumable", "batch": 3}
    ranges = broker.chunks(dt.date(2000, 1, 1), dt.date(2012, 1, 1), "day")
    assert len(ranges) == 3
    with pytest.raises(Exception, match="refused"):
        broker.download(spark, **ask)
    before = open(log).read().count("A ")
    fail.unlink()
    got = broker.download(spark, **ask)
    assert before == 3 == open(log).read().count("A "), "the finished batch is not fetched again"
    rows = got.collect()
    assert len(rows) == 2 * 2 * len(ranges) and {r.symbol for r in rows} == {"A", "B"} and {r.oi for r in rows} == {3}
    assert not list((tmp_path / "data" / "chunks").glob("*"))
    about = {r.symbol: (r.total_candles, r.first_candle[:10]) for r in spark.read.json(str(tmp_path / "data" / "metadata")).collect()}
    assert about == {"A": (6, "2000-01-01"), "B": (6, "2000-01-01")}
    with pytest.raises(ValueError, match="no symbols"):
        broker.download(spark, **ask | {"symbols": []})


def test_invalid_candles_are_not_written(spark, tmp_path):
    def client():
        return lambda symbol, interval, start, end: [{"date": __import__("datetime").datetime(2020, 1, 1), "open": 5, "high": 2, "low": 0.5, "close": 1.5, "volume": 7}]

    spark.dataSource.register(broker.candle_source(client, "invalid"))
    with pytest.raises(ValueError, match="invalid bars"):
        broker.download(spark, str(tmp_path), ["A"], "day", "2020-01-01", "2020-02-01", "invalid")
    assert not (tmp_path / "bars").exists()


def test_candles_with_open_interest(spark):
    row = {"date": dt.datetime(2020, 1, 1), "open": 1, "high": 2, "low": 1, "close": 2, "volume": 3}
    assert broker.candles(spark, [row]).columns[-1] == "volume"
    assert broker.candles(spark, [row | {"oi": 4}]).head().oi == 4 and broker.candles(spark, []).count() == 0


def test_instrument_master(spark, tmp_path):
    master = broker.Instruments(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        master.token("ABC")
    master.refresh([{"instrument_token": 1, "tradingsymbol": "OLD", "exchange": "NSE"}])
    master.refresh([{"instrument_token": 5, "tradingsymbol": "ABC", "exchange": "NSE"}, {"instrument_token": 6, "tradingsymbol": "ABC", "exchange": "BSE"}])
    assert (master.token("ABC"), master.token("ABC", "BSE"), master.exchange("ABC", "NFO")) == (5, 6, "BSE")
    with pytest.raises(KeyError):
        master.exchange("OLD")
