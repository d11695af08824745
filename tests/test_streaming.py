import numpy as np
import pandas as pd

from tidemill.operators.backtest import rate_limited
from tidemill.operators.signals import smooth_scores
from tidemill.streaming.folds import stream_ema, stream_positions


def test_streams_continue_where_the_last_trigger_ended(spark, tmp_path):
    days = pd.date_range("2024-01-01", periods=12)
    r = np.random.default_rng(0)
    rows = [(t, d.to_pydatetime(), None if i % 5 == 2 else float(r.normal())) for t in ("A", "B") for i, d in enumerate(days)]
    schema = "ticker string, date timestamp, score double"
    table = spark.createDataFrame(rows, schema)
    for i, (a, b) in enumerate((("2024-01-01", "2024-01-05"), ("2024-01-06", "2024-01-12"))):
        table.where(f"date BETWEEN '{a}' AND '{b}'").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))

    def run(name, make):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    want = smooth_scores(table, smoothing="ema_3").select("ticker", "date", "score_smoothed").toPandas().sort_values(["ticker", "date"])
    got = run("ema", stream_ema).toPandas().sort_values(["ticker", "date"])
    np.testing.assert_allclose(got["score_smoothed"].astype(float), want["score_smoothed"].astype(float), equal_nan=True)
    filled = table.fillna(0.0, ["score"])
    want = rate_limited(filled, target="score", out="pos", keys=["ticker"], order=["date"], K=1.0, step_frac=0.25).toPandas().sort_values(["ticker", "date"])
    got = run("pos", lambda s: stream_positions(s, target="score")).toPandas().sort_values(["ticker", "date"])
    np.testing.assert_allclose(got["pos"], want["pos"])
