import json
from datetime import datetime

from marlstone.operators.cache import Store
from marlstone.operators.dedupe import ITEM
from marlstone.operators.refine import Refiner
from marlstone.plans import search as S
from tests.test_operators import item

NOW = datetime(2026, 1, 1)
ANSWER = json.dumps({"groups": [{"canonical": "Foo", "originals": ["Foo", "Fuu"]}], "ranking": ["b"]})


def loaders(calls, titles=("[a] Foo - 01", "[b] Fuu - 01", "[c] Bar - 01")):
    def load(spark, query):
        calls.append(query.keyword)
        return spark.createDataFrame([item(k, t, seeders=k) for k, t in enumerate(titles)], ITEM)

    return {"nyaa": load}


def test_both_phases_read_the_sources_once(spark, tmp_path):
    calls, asked = [], []
    model = Refiner(lambda names, crews: asked.append(names) or ANSWER)
    store = Store(spark, f"file://{tmp_path}/cache", 60, buckets=2, sweep_chance=0)
    texts = list(map(json.loads, S.two_phases(spark, S.Query("a  B"), loaders(calls), model, store, NOW)))
    assert calls == ["a  B"] and len(asked) == 1 and [t["refined"] for t in texts] == [False, True]
    assert [len(t["groups"]) + len(t["ungrouped"]) for t in texts] == [3, 2]  # the model joins two series, of which the best release stays
    assert texts[0]["query"] == {"keyword": "a B", "limit": 20, "offset": 0, "sources": [], "prefer": None} and texts[0]["total"] == 3
    # The refined entry answers any request, and so there is one phase.
    again = list(S.two_phases(spark, S.Query("A b"), loaders(calls), model, store, NOW))
    assert len(again) == 1 and json.loads(again[0]) == texts[1] and len(calls) == len(asked) == 1
    assert S.answered(spark, S.Query("a b", refine=False), {}, None, store, NOW) == again[0]


def test_a_request_that_was_overtaken_yields_no_more(spark):
    calls, asked, sequence = [], [], S.Sequence()
    model = Refiner(lambda names, crews: asked.append(names) or ANSWER)
    old = S.two_phases(spark, S.Query("old"), loaders(calls), model, sequence=sequence)
    assert json.loads(next(old))["refined"] is False
    new = S.two_phases(spark, S.Query("new"), loaders(calls), model, sequence=sequence)
    assert json.loads(next(new))["query"]["keyword"] == "new"
    assert list(old) == [] and asked == []  # the old refined phase is not begun
    assert [json.loads(t)["refined"] for t in new] == [True] and len(asked) == 1

    def slow(spark, query):
        sequence.begin()  # another request comes in meanwhile
        return loaders([])["nyaa"](spark, query)

    assert list(S.two_phases(spark, S.Query("late"), {"nyaa": slow}, model, sequence=sequence)) == []


def test_groups_are_nested(spark):
    titles = ["[a] Show - 01", "[a] Show - 02 [1080p]", "[b] Other - 01", "[c] Other - 03", "[c] Other - 02", "[d] Lone"]
    got = json.loads(S.response_text(S.search(spark, S.Query("x", refine=False), loaders([], titles)), S.Query("x")))
    assert {g["key"]: [i["episode"] for i in g["items"]] for g in got["groups"]} == {"show": [2, 1], "other": [3, 2, 1]}
    assert got["groups"][0]["series"] in ("Show", "Other") and [i["title"] for i in got["ungrouped"]] == ["[d] Lone"] and got["total"] == 6
    assert set(got) == {"query", "total", "warnings", "groups", "ungrouped", "refined"} and "season" not in got["groups"][0]


def test_arguments_of_many_requests_are_those_of_one(spark):
    rows = [("a  B", "5", "2", "nyaa, dmhy", "simplified", "0"), ("x", "1e9", "-1", "bad", "other", "1"), ("x", "abc", "abc", None, None, None), ("　", None, None, "", "", ""), (None, "0", "7.9", "acg-rip,acg-rip", "traditional", "no"), ("y", "-0.5", "", ",", None, "0")]
    names = ("q", "limit", "offset", "sources", "prefer", "refine")
    got = S.arguments(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))).collect()
    for row, r in zip(rows, got, strict=True):
        params = {n: v for n, v in zip(names, row, strict=True) if v is not None}
        try:
            q = S.Query.of(params)
        except ValueError:
            assert r.keyword is None
            continue
        assert (r.keyword, r.n_limit, r.n_offset, tuple(r.named), r.script, r.refined) == (q.cleaned, q.limit, q.offset, q.sources, q.prefer, q.refine)
