import shutil
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

from marlstone.operators.cache import Store
from marlstone.operators.refine import Refiner, prompt, text_model
from marlstone.plans import search as S

TOP = Path(__file__).resolve().parents[1]


def test_queries_without_the_corpus_operators(tmp_path):
    for gone in ((), ("corpus_pipeline.py",)):
        at = tmp_path / f"copy{len(gone)}"
        shutil.copytree(TOP, at, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *gone))
        code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 40 and not any(k.startswith('op') or k == 'pipeline' for k in q)"
        subprocess.run([sys.executable, "-c", code], cwd=at, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(at)})


def test_store_fails_open(spark, tmp_path):
    now = datetime(2026, 1, 1)
    store = Store(spark, f"file://{tmp_path}/cache", 60)
    assert store.get("k", now) is None
    assert store.put("k", "one", now) and store.put("k", "two", now + timedelta(seconds=1))
    assert store.get("k", now + timedelta(seconds=5)) == "two" and store.get("k", now + timedelta(seconds=61)) is None
    assert not Store(spark, "nowhere://x/y").put("k", "v", now) and Store(spark, "nowhere://x/y").get("k", now) is None
    assert S.Query("　a \t b ").cleaned == "a b"


def test_a_slow_model_counts_as_failed():
    import time

    asked = []
    quick = Refiner(text_model(lambda text, max_tokens: asked.append((text, max_tokens)) or '{"groups": [], "ranking": []}'))
    assert quick.ask(["a", "b"], ["x"]) and asked == [(prompt(["a", "b"], ["x"]), 2048)]
    assert Refiner(lambda a, b: time.sleep(3) or "{}", seconds=0.2).ask(["a", "b"], []) == []
