import threading

import pytest

from quarry.operators import cache, jobs
from quarry.plans.query import plan


def test_rate():
    assert jobs.rate(50, 100, 5.0) == (10.0, 5.0) and jobs.rate(0, 10, 0.0) == (0.0, None) and jobs.rate(10, 5, 1.0) == (10.0, 0.0)


def test_page_cache(spark):
    now, made = [0.0], []
    c = cache.PageCache(entries=2, seconds=10, clock=lambda: now[0])

    def make(p):
        made.append(p.text)
        return spark.range(1)

    a = c.get(plan("a"), make)
    assert c.get(plan("a", extensions=set()), make) is a and a.is_cached
    now[0] = 11
    c.get(plan("a"), make), c.get(plan("b"), make), c.get(plan("c"), make)
    assert made == ["a", "a", "b", "c"] and not a.is_cached
    c.get(plan("a"), make)
    c.clear()
    assert made[-1] == "a" and len(made) == 5 and not c._pages


def test_cancel(spark):
    stopped = []

    def run():
        with jobs.tagged(spark, "slow"), pytest.raises(Exception, match="(?i)cancel|interrupt"):
            spark.range(0, 10**10, 1, 4).selectExpr("sum(sqrt(id * 1.5))").collect()
        stopped.append(True)

    t = threading.Thread(target=run, daemon=True)
    t.start()
    for _ in range(60):
        jobs.cancel(spark, "slow")
        t.join(0.5)
        if not t.is_alive():
            break
    assert stopped
