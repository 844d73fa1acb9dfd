"""File sources and sinks."""

import json
import tempfile

from panelspark.sources import files as fs


def test_sources(spark):
    d = tempfile.mkdtemp(prefix="spark-files-", dir="/tmp")

    def put(name, text):
        with open(f"{d}/{name}", "w") as f:
            f.write(text)
        return f"{d}/{name}"

    assert [r.symbol for r in fs.instruments(spark, put("i.tsv", "B\t2020\t2021\nA\t2019\t2021\nB\t2022\t2023\n")).collect()] == ["A", "B"]
    got = fs.symbols_csv(spark, put("s.csv", "Name,Symbol\nx,BRK.B\ny, A \nz,\nw,BRK.B\n")).orderBy("ord").collect()
    assert [r.ticker for r in got] == ["BRK-B", "A"]
    assert [r.ticker for r in fs.ticker_lines(spark, put("t.txt", "A\n\n# no\n B \n")).collect()] == ["A", "B"]
    assert [(r.ticker, r["rank"]) for r in fs.market_caps(spark, put("c.json", '{"A": 1, "B": 5}')).orderBy("rank").collect()] == [("B", 1), ("A", 2)]
    t = {"time": "2024-01-01", "symbol": "A", "side": "BOT", "quantity": 1, "price": 2}
    for k, shape in enumerate(([t], {"trades": [t]}, {"x": [t], "y": []}, {"x": t})):
        assert fs.trades_json(spark, put(f"{k}.json", json.dumps(shape))).collect()[0].symbol == "A"


def test_sinks(spark):
    d = tempfile.mkdtemp(prefix="spark-files-", dir="/tmp")
    df = spark.createDataFrame([("f", 1, float("nan")), ("f", 2, 1.0)], "factor string, k int, v double")
    fs.write_json(df, f"{d}/j", "factor")
    assert [x.v for x in spark.read.json(f"{d}/j").first().rows] == [None, 1.0]
    fs.write_report_csv(df, f"{d}/c")
    assert spark.read.csv(f"{d}/c", header=True).count() == 2
    fs.rewritten(df, f"{d}/store")
    fs.rewritten(fs.latest_version(spark, f"{d}/store").limit(1), f"{d}/store")
    assert fs.latest_version(spark, f"{d}/store").count() == 1
