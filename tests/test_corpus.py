"""Sources, parsing, auditing and the limiter."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import text as tx
from lumenfold.operators import etl
from lumenfold.sources import passages as src
from lumenfold.streaming import limiter

BOOK = """Title page
VERSES 1 - 3
Overview that speaks of [9:9] first.
My Book page
VERSES 1 - 2

Praise is due [1:1] and the Lord2 of all [1:2]
Commentary that cites [3:4] and [1:3] early.
7 out of 9
VERSES 3 - 4
The Merciful [1:3] [1:4] Master of the day
12 A footnote
More talk on [2:2] here.
VERSES 99
Nothing of this chapter [5:99]
"""


def test_sections():
    text = "\n".join(x for x in BOOK.split("\n") if x.strip() and not x.startswith(("My Book", "7 out", "12 A")))
    a, b = etl.parse_text(text, 1)
    assert a.verses == {1: "Praise is due", 2: "and the Lord of all"} and a.commentary == "Commentary that cites [3:4] and [1:3] early"
    assert b.verses[3] == "The Merciful" and b.verses[4].startswith("Master of the day")
    assert etl.parse_text("", 1) == [] and etl.parse_text("\nVERSES\n", 1) == []


def test_documents_keep_going_after_an_error(spark):
    docs = spark.createDataFrame([(1, 1, BOOK), (2, 2, None), (3, 1, BOOK)], "position long, chapter int, text string")
    parsed = etl.parse_documents(docs, "My Book")
    assert parsed.where("error is not null").select("position").collect()[0][0] == 2
    kept, report = etl.rebuild(docs, "My Book")
    assert sorted(r["ref"] for r in kept.collect()) == ["1:1", "1:2", "1:3", "1:4"]
    rows = {r["position"]: r for r in report.collect()}
    assert rows[1]["new"] == 4 and rows[3]["new"] == 0 and rows[3]["parsed"] == 4 and rows[2]["error"]


def test_json_lines(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"ref": "1:1", "text": "a", "commentary": "long", "arabic": null}\n\n{"ref": "1:2", "text": "b"}\n')
    got = src.read_passages(spark, f"file://{path}").orderBy("row_idx").collect()
    assert [(r["ref"], r["commentary"], r["arabic"]) for r in got] == [("1:1", "long", ""), ("1:2", "", "")]
    assert {r["commentary"] for r in src.read_passages(spark, f"file://{path}", with_commentary=False).collect()} == {""}
    path.write_text('{"text": "a"}\n')
    with pytest.raises(Exception, match="no ref"):
        src.read_passages(spark, f"file://{path}").collect()
    path.write_text("{broken\n")
    with pytest.raises(Exception):
        src.read_passages(spark, f"file://{path}").collect()
    assert src.choose_corpus("/none", "sample") == "sample" and src.choose_corpus("/none", "sample", "own") == "own" and src.choose_corpus("/", "s") == "/"


def test_passages_in_order(spark, tmp_path):
    rows = spark.createDataFrame([("10:1", "x"), ("2:10", "é"), ("2:9", "y")], "ref string, text string").coalesce(1)
    src.write_passages(rows, f"file://{tmp_path}/o")
    lines = [json.loads(x) for f in sorted(os.listdir(tmp_path / "o")) if f.endswith(".json") for x in (tmp_path / "o" / f).read_text().splitlines()]
    assert [x["ref"] for x in lines] == ["2:9", "2:10", "10:1"] and lines[1]["text"] == "é"


def test_manifest_documents_translation(spark, tmp_path):
    (tmp_path / "m.txt").write_text("1|a.txt\n\n 2 | b c.txt\n")
    got = src.read_manifest(spark, f"file://{tmp_path}/m.txt").orderBy("position").collect()
    assert [(r["chapter"], r["file"]) for r in got] == [(1, "a.txt"), (2, "b c.txt")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("one\ftwo")
    (tmp_path / "d" / "b.txt").write_text("bad")

    def pages(content):
        if content == b"bad":
            raise OSError("unreadable")
        return [*src.page_texts(content), None]

    docs = {r["path"][-5:]: r for r in src.read_documents(spark, f"file://{tmp_path}/d", pages).collect()}
    assert docs["a.txt"]["text"] == "one\ntwo\n" and docs["b.txt"]["error"] == "OSError: unreadable"
    (tmp_path / "t.json").write_text(json.dumps({"data": {"surahs": [{"number": 1, "ayahs": [{"numberInSurah": 1, "text": "x"}, {"numberInSurah": 2, "text": "y"}]}]}}))
    assert [r["ref"] for r in src.read_translation(spark, f"file://{tmp_path}/t.json").orderBy("verse").collect()] == ["1:1", "1:2"]


def test_commentary_store(spark, tmp_path):
    rows = spark.createDataFrame([("1:1", "long"), ("1:2", None)], "ref string, commentary string")
    assert src.CommentaryStore.build(rows, f"file://{tmp_path}/kv") == {"n_rows": 2, "with_commentary": 1}
    store = src.CommentaryStore(spark, f"file://{tmp_path}/kv")
    assert store.get("1:1") == "long" and store.get("9:9") == "" and store.has("1:1") and not store.has("1:2") and len(store) == 1
    with pytest.raises(ValueError, match="not unique"):
        src.CommentaryStore.build(rows.union(rows), f"file://{tmp_path}/kv2")
    with pytest.raises(Exception):
        src.CommentaryStore(spark, f"file://{tmp_path}/absent")


def test_embeddings(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"1:{i}", f"t{i}") for i in range(70)], "row_idx long, ref string, text string").coalesce(1)
    waits = f"{tmp_path}/tries"

    def embed(texts):
        if len(texts) > 32:
            raise ValueError("too many")
        if not os.path.exists(waits):
            open(waits, "w").close()
            raise OSError("busy")
        return [[3.0, 4.0] if t != "t5" else [0.0, 0.0] for t in texts]

    src.write_embeddings(src.embed_passages(rows, embed, wait=lambda s: None), f"file://{tmp_path}/e")
    got = {r["row_idx"]: list(r["embedding"]) for r in src.read_embeddings(spark, f"file://{tmp_path}/e").collect()}
    assert len(got) == 70 and got[5] == [0.0, 0.0] and got[0] == pytest.approx([0.6, 0.8])


def test_audit(spark):
    texts = ["mercy covers every created thing", "patience brings reward later", "forgive people openly always", "prayer keeps believers upright", "charity cleanses wealth fully"]
    ref = spark.createDataFrame([(f"1:{i + 1}", t) for i, t in enumerate(texts)], "ref string, text string")
    rows = [(0, "1:1", texts[0]), (1, "1:2", texts[1]), (2, "1:4", texts[2]), (3, "1:5", texts[3]), (4, "1:3", texts[2] + " extra words here"), (5, "1:6", "unrelated scribble altogether"), (6, "9:1", "")]
    corpus = spark.createDataFrame(rows, "row_idx long, ref string, text string")
    got = {r["row_idx"]: r for r in etl.audit(corpus, ref).collect()}
    assert [got[i]["target"] for i in range(7)] == ["1:1", "1:2", "1:3", "1:4", "1:3", "1:6", "9:1"]
    assert got[2]["moved"] and not got[4]["moved"] and got[5]["weak"] and got[6]["own"] == 0
    kept = [(r["row_idx"], r["ref"]) for r in etl.realigned(etl.audit(corpus, ref), corpus).collect()]
    assert kept == [(0, "1:1"), (1, "1:2"), (2, "1:3"), (3, "1:4"), (5, "1:6"), (6, "9:1")]
    assert etl.audit_summary(etl.audit(corpus, ref)).first().asDict() == dict(n_rows=7, misaligned=2, weak=2, kept=6, dropped=1)


def test_limiter_in_a_process():
    now = [0.0]
    r = limiter.RateLimiter(2, 10, lambda: now[0])
    assert r.check("a") == (True, 0) and r.check("a") == (True, 0)
    ok, wait = r.check("a")
    assert not ok and 1 <= wait <= 11 and r.check("b")[0]
    now[0] = 10.5
    assert r.check("a")[0]
    assert all(limiter.RateLimiter(0, 10).check("x")[0] for _ in range(50))
    many = limiter.RateLimiter(1, 1, lambda: now[0])
    for i in range(limiter.SWEEP + 1):
        many.check(i)
    now[0] += 5
    many.check("last")
    assert len(many.logs) == 1


def test_limiter_batch_and_stream_agree(spark, tmp_path):
    rows = [(f"k{i % 3}", i * 1_000_000) for i in range(40)] + [("k0", 7_000_000)]
    df = spark.createDataFrame(rows, "key string, ts long")
    batch = sorted(map(tuple, limiter.limited(df, 2, 12).collect()))
    df.write.parquet(f"file://{tmp_path}/in")
    q = limiter.limited_stream(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in"), 2, 12, forget=False).writeStream.format("memory").queryName("lim").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert sorted(map(tuple, spark.table("lim").collect())) == batch and any(not r[2] for r in batch)
    assert all(r[2] for r in limiter.limited(df, 0, 12).collect())
    assert limiter.limited(df.where(F.lit(False)), 2, 12).count() == 0


@pytest.mark.parametrize("keep", [False, True])
def test_cleaning_is_the_same_in_python_and_as_a_column(spark, keep):
    texts = ["", "a1", "Word12 next [1:2] , end .", "one\n12\nTwo3[4:5]six 7\n ... \nThe end . .", " . . Some text3, here [9:9]; and 'quoted4' x12345 .", "ab\t\tcd \n99\nef[1:1]2 gh", "no marks: at all ! ?"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.clean(F.col("t"), keep).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in got] == [etl.clean_text(t, keep) for t in texts]


def test_last_texts_and_pages(spark):
    rows = spark.createDataFrame([(1, "1:1", "old"), (3, "1:1", "new"), (2, "1:1", "mid"), (4, "1:2", "x")], "position int, ref string, text string")
    assert {tuple(r) for r in etl.last_texts(rows).collect()} == {("1:1", "new"), ("1:2", "x")}
    many = spark.createDataFrame([(f"{c}:{v}", "t") for c in (2, 10, 1) for v in range(1, 12)], "ref string, text string")
    assert [(r["ref"], r["n"]) for r in src.page(many, 2, 11).orderBy("n").collect()] == [(f"2:{v}", 11 + v) for v in range(1, 12)]
    names = spark.createDataFrame([(1, "a"), (1, "b")], "k int, name string")
    assert sorted(tuple(r) for r in src.with_names(spark.createDataFrame([(1,), (2,)], "k int"), names, "k", "name").collect()) == [(1, "b"), (2, "")]


def test_limiter_is_safe_among_threads():
    from concurrent.futures import ThreadPoolExecutor

    from lumenfold.streaming.limiter import RateLimiter

    one = RateLimiter(50, 300, clock=lambda: 1.0)
    with ThreadPoolExecutor(16) as pool:
        allowed = sum(ok for ok, _ in pool.map(lambda _: one.check("k"), range(2000)))
    assert allowed == 50


def test_package_exports():
    import lumenfold

    assert all(getattr(lumenfold, n) is not None for n in lumenfold.__all__)


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from lumenfold.session import scratch

    conf = SimpleNamespace(get=lambda k: None)
    context = lambda master, folder=None: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf, getCheckpointDir=lambda: folder))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch(context("spark://m:7077"))
    assert scratch(context("yarn", "hdfs:///c")).startswith("hdfs:///c/") and scratch(context("local[4]")).startswith("file://")
