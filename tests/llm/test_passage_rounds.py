"""Operator 6: the rounds' tables stay one scan."""

import glob
import random
import time

import numpy as np
from pyspark.sql import functions as F

from panelspark.llm import common, passages


def test_rounds_are_one_scan(spark):
    found = passages.Rounds("numbers")
    parts = [found.add(spark.range(k, k + 2).repartition(2)) for k in (0, 10, 20)]
    assert [sorted(r.id for r in p.collect()) for p in parts] == [[0, 1], [10, 11], [20, 21]]
    assert sorted(r.id for r in found.all().collect()) == [0, 1, 10, 11, 20, 21]
    plan = found.all()._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Relation") == 1


def test_steps_leave_no_shuffle_files(spark):
    """What a step of the rounds shuffled is gone when it ends (before: when the driver happened to collect its garbage)."""
    files = lambda: set(glob.glob(f"{spark.conf.get('spark.local.dir')}/**/shuffle_*", recursive=True))
    before, key = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    with common.without_shuffle_files(spark):
        df = common.stored(spark.range(50_000).groupBy((F.col("id") % 7_000).alias("k")).agg(F.count("*").alias("n")), "numbers")
    assert spark.conf.get(key, None) == was
    for _ in range(50):  # files are removed in the background
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and df.count() == 7_000


def test_vain_places_lead_on_only_where_near(spark, monkeypatch):
    """Documents that share a few phrases with one of a family are compared with that one, and not with its partners after it."""
    rng = random.Random(3)
    words = lambda n, k: [f"{k}w{rng.randint(0, 10**9)}" for _ in range(n)]
    base = words(80, "b")

    def edited():
        out = list(base)
        for k in rng.sample(range(80), 2):
            out[k] = f"e{rng.randint(0, 10**9)}"
        return out

    family = [edited() for _ in range(40)] + [base]
    # two short pieces of the text among other words, never near it
    quoting = [words(25, "q") + base[10:18] + words(25, "q") + base[50:58] + words(25, "q") for _ in range(40)]
    asked = []
    monkeypatch.setattr(passages, "through_hubs", lambda tried, *a, f=passages.through_hubs: (asked.append(f(tried, *a)), asked[-1])[1])
    rows = [(i, " ".join(t)) for i, t in enumerate(family + quoting)]
    got = passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    met = {(r.doc, r.rdoc) for df in asked for r in df.collect()}
    assert {r.doc_id for r in got} <= set(range(41)) and len({r.class_id for r in got}) == 1
    assert not [p for p in met if max(p) > 40 >= min(p)]


def test_densest_run():
    hit = np.zeros(200, bool)
    hit[50:60] = hit[90:100] = True
    assert passages.densest(hit) == 16 and passages.densest(hit[:55]) == 5 and passages.densest(hit[:10]) == 0
    assert passages.NEAR == 23
