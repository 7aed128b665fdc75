from marlstone.sources.datasource import register


def test_feed_source(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / f"{n}.xml").write_text(f"<rss><item>{n}1</item>\n<item x='y'>{n}2</item></rss>")
    register(spark)
    df = spark.read.format("feed").option("paths", f"{tmp_path}/a.xml,{tmp_path}/b.xml").load()
    assert sorted((r.pos, r.block) for r in df.collect()) == [(0, "a1"), (0, "b1"), (1, "a2"), (1, "b2")]


def test_feeds_stream_in_chunks_of_any_size():
    import re

    from marlstone.sources.datasource import items

    text = "<rss>x<item>é1</item><items>no</items>\n<item a='1'>2<b>c</b></item ><item>3</item></it<item\n>4</item><item>open" * 3
    want = re.findall(r"<item\b[^>]*>([\s\S]*?)</item>", text)
    for size in (1, 2, 3, 7, 50, 1000):
        assert list(items((text[k : k + size] for k in range(0, len(text), size)), "item")) == want
    assert list(items(iter(()), "item")) == []


def test_a_cluster_without_a_shared_folder_is_told_so():
    from types import SimpleNamespace

    import pytest

    from marlstone.staging import shared_root

    unset = SimpleNamespace(get=lambda *a: None)
    context = lambda master: SimpleNamespace(getConf=lambda: unset, applicationId=f"app-{master}", master=master)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(SimpleNamespace(conf=unset, sparkContext=context("spark://host:7077")))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(SimpleNamespace(conf=unset, sparkContext=context("local-cluster[2,1,1024]")))
    assert shared_root(SimpleNamespace(conf=unset, sparkContext=context("local[2]"))).startswith("file:///")
    named = SimpleNamespace(get=lambda *a: "hdfs://shared/x/")
    assert shared_root(SimpleNamespace(conf=named, sparkContext=context("yarn"))) == "hdfs://shared/x/marlstone/app-yarn"
