import os
import subprocess
import sys
import threading
import time
from collections import Counter

from plainlens.models import generate, ledger


def rows_of(spark, n=30):
    return spark.createDataFrame([(i, f"texto {i}") for i in range(n)], "k long, t string").repartition(3)


def counting(log, fail=lambda k, seed: False, pause=0.0):
    def factory():
        def ask(system, user, seed):
            with open(log, "a") as f:
                f.write(f"{user.split()[-1]} {seed}\n")
            time.sleep(pause)
            if fail(int(user.split()[-1]), seed):
                raise RuntimeError("busy")
            return f"{user}/{seed}"

        return ask

    return factory


def counts(log):
    return Counter(tuple(map(int, x.split())) for x in open(log).read().splitlines())


def test_requests_are_made_once_over_runs_and_uses(spark, tmp_path):
    log, book, once = str(tmp_path / "log"), str(tmp_path / "book"), str(tmp_path / "once")
    fail = lambda k, seed: k == 4 and seed % 2 == 0 and not os.path.exists(once)
    ask = dict(key="k", text="t", system="s", template="{text}", n=2, seeds_per_row=10, concurrency=4, parallel=3, ledger=book)
    first = generate.completions(rows_of(spark, 20), factory=counting(log, fail), **ask)
    got = {r.k: r for r in first.collect()}
    assert len(got) == 20 and got[4].out_1 is None and got[4].error == "RuntimeError: busy" and got[5].out_2 == "texto 5/93"
    open(once, "w").close()
    again = {r.k: r for r in first.collect()}  # the same plan: only what failed is asked
    assert again[4].out_1 == "texto 4/82" and again[4].error is None
    more = {r.k: r for r in generate.completions(rows_of(spark, 30), factory=counting(log), **ask | {"concurrency": 7}).collect()}
    assert len(more) == 30 and all(more[k].out_1 == again[k].out_1 for k in again)
    assert counts(log) == {(k, 42 + 10 * k + i): 2 if (k, i) == (4, 0) else 1 for k in range(30) for i in range(2)}
    with open(f"{book}/{sorted(os.listdir(book))[0]}", "a") as f:
        f.write('{"k": 1, "seed"')  # cut short
    assert ledger.recorded(spark, book).count() == 60


SCRIPT = """
import os, sys, time
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from plainlens.models import generate
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")

def factory():
    def ask(system, user, seed):
        k = int(user.split()[-1])
        if k == 17 and not os.path.exists({mark!r}):
            open({mark!r}, "w").close()
            os._exit(1)
        with open({log!r}, "a") as f:
            f.write(f"{{k}} {{seed}}\\n")
        return "x"
    return ask

df = spark.createDataFrame([(i, f"texto {{i}}") for i in range(40)], "k long, t string")
out = generate.completions(df, "k", "t", factory, "s", "{{text}}", n=2, seeds_per_row=2, concurrency=2, ledger={book!r})
print("ROWS", out.count(), out.filter("error IS NOT NULL").count())
"""


def test_a_killed_worker_repeats_no_request(tmp_path):
    paths = {"log": str(tmp_path / "log"), "book": str(tmp_path / "book"), "mark": str(tmp_path / "mark"), "root": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    env = os.environ | {"PYTHONPATH": paths["root"]}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(**paths)], capture_output=True, text=True, timeout=300, env=env)
    assert "ROWS 40 0" in out.stdout, out.stderr[-2000:]
    assert os.path.exists(paths["mark"]) and counts(paths["log"]) == {(k, 42 + 2 * k + i): 1 for k in range(40) for i in range(2)}


def test_bounded_concurrency():
    lock, now, most = threading.Lock(), [0], [0]

    def ask(k):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.01)
        with lock:
            now[0] -= 1
        return str(k)

    taken = []
    requests = (taken.append(k) or (k,) for k in range(50))
    got = [a for _, a, _ in ledger.answered(requests, ask, 4)]
    assert sorted(got, key=int) == [str(k) for k in range(50)] and 2 <= most[0] <= 4 and taken == list(range(50))
