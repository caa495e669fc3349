"""Training by epochs against the same steps in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandcut.functions import schedule
from strandcut.operators import training


def rows(n=120, d=5):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, d))
    y = (x @ rng.normal(size=d) + rng.normal(size=n) > 0.4).astype(int)
    return x, y, np.arange(n) % 4 == 0


def by_hand(x, y, test, rates, weights):
    x = np.column_stack([x, np.ones(len(x))])
    w, out = np.zeros(x.shape[1]), []
    for rate in rates:
        z, c = x @ w, np.where(y == 1, weights[1], weights[0])
        loss = c * np.log1p(np.exp(np.where(y == 1, -z, z)))
        counts = [int((test & a & b).sum()) for a, b in ((z > 0, y == 1), (z > 0, y == 0), (z <= 0, y == 1), (z <= 0, y == 0))]
        out.append((loss[~test].sum() / c[~test].sum(), loss[test].sum() / c[test].sum(), counts, w.copy()))
        w = w - rate * ((c * (1 / (1 + np.exp(-z)) - y))[~test] @ x[~test]) / c[~test].sum()
    return out


def frame(spark, x, y, test):
    return spark.createDataFrame(
        [(a.tolist(), int(b), bool(t)) for a, b, t in zip(x, y, test)], "v array<double>, y int, test boolean"
    ).repartition(5)


@pytest.mark.parametrize("name", ["cosine", "milestone"])
def test_epochs_by_hand(spark, name):
    x, y, test = rows()
    rate = {"cosine": lambda e: schedule.cosine_decay(e, 0.8, 6), "milestone": lambda e: schedule.milestone_decay(e, 0.8, [2, 4])}[name]
    rates = [r[0] for r in spark.range(7).select(rate(F.col("id"))).collect()]
    got = training.train_epochs(
        frame(spark, x, y, test), "v", "y", "test", width=5, epochs=6, rate=rate, class_weights=(0.3, 0.7)
    ).orderBy("epoch").collect()
    assert [r.epoch for r in got] == list(range(7)) and [r.rate for r in got] == pytest.approx(rates)
    for r, (loss, held, counts, w) in zip(got, by_hand(x, y, test, rates, (0.3, 0.7))):
        assert (r.loss, r.eval_loss) == pytest.approx((loss, held)) and r.weights == pytest.approx(w.tolist())
        assert [r.tp, r.fp, r.fn, r.tn] == counts
        assert r.accuracy == pytest.approx((counts[0] + counts[3]) / sum(counts))
    assert got[-1].loss < got[0].loss


def test_a_stopped_run_goes_on(spark, tmp_path):
    x, y, test = rows()
    df, store = frame(spark, x, y, test), str(tmp_path / "epochs")
    whole = training.train_epochs(df, "v", "y", "test", width=5, epochs=5)
    training.train_epochs(df, "v", "y", "test", width=5, epochs=2, store=store)
    again = training.train_epochs(df, "v", "y", "test", width=5, epochs=5, store=store)
    for a, b in zip(whole.orderBy("epoch").collect(), again.orderBy("epoch").collect()):
        assert a.weights == pytest.approx(b.weights) and a.loss == pytest.approx(b.loss)
    assert len(training.stored_epochs(spark, store)) == 6 and spark.read.parquet(store).count() == 6


def test_nulls_and_no_rows(spark):
    df = spark.createDataFrame([([1.0], 1, False), (None, 1, False), ([1.0], None, True), ([2.0], 0, None)], "v array<double>, y int, test boolean")
    got = training.train_epochs(df, "v", "y", "test", width=1, epochs=1).orderBy("epoch").collect()
    assert got[1].weights == pytest.approx([0.05, 0.05]) and got[0].eval_loss is None and got[0].tn == 0
    none = training.train_epochs(df.limit(0), "v", "y", "test", width=1, epochs=1).collect()
    assert len(none) == 2 and all(r.loss is None and r.weights == [0.0, 0.0] for r in none)
