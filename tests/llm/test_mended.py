"""Cases that went wrong: clashing internal names, folders of a failed first write, repeated words, a bucket of many fingerprints."""

import json
import time

import pytest
from pyspark.sql import functions as F

from gristmill.llm import decontaminate, simhash, warc


def test_one_of_each_keeps_any_column(spark):
    rows = [(1, "one two three four", 77, 5.5, "a", 9), (2, "one two three four", 78, 6.5, "b", 9), (3, "quite another text here", 79, 7.5, "c", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __row long, __fp double, first string, n long")
    assert sorted(map(tuple, simhash.one_of_each(df).collect())) == [rows[0], rows[2]]
    back = df.select("n", "__fp", "text", "first", "__row", "doc_id")
    assert simhash.one_of_each(back).columns == back.columns and simhash.one_of_each(back).count() == 2


def test_a_hot_bucket_keeps_its_links(spark, monkeypatch):
    """Fingerprints of one bucket in every table but one, cut into many parts."""
    monkeypatch.setattr(simhash, "BUCKET", 16)
    fps = [k for k in range(300)] + [1 << 60, (1 << 60) + 7]
    links = {(r.a, r.b) for r in simhash.near_links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: x for x in fps}

    def root(x):
        while want[x] != x:
            x = want[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= simhash.RADIUS:
                want[max(root(a), root(b))] = min(root(a), root(b))
    assert {x: find(x) for x in fps} == {x: root(x) for x in fps}


def _hits(text, items):
    """Hit words and items by looking at every window."""
    words, hit, found = decontaminate.words_of(text), set(), set()
    for name, body in items:
        own = decontaminate.words_of(body)
        n = min(len(own), decontaminate.WINDOW)
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(name)
    return hit, found


def test_repeated_words_are_judged_at_once():
    same = b"very " * 20_000
    began = time.time()
    n, hit, items = decontaminate.judge(same, decontaminate.Matcher([("a", same)]))
    assert (n, int(hit.sum()), items) == (20_000, 20_000, {"a"}) and time.time() - began < 5
    cases = [
        (b"x " * 40 + b"y " + b"x " * 60, [("a", b"x " * 30), ("b", b"x " * 20 + b"y " + b"x " * 25), ("c", b"y " * 14)]),
        (b"x y " * 50 + b"z " + b"y x " * 30, [("a", b"x y " * 20), ("b", b"y x " * 9 + b"z " + b"y x " * 3), ("c", b"x x " * 20)]),
        (b"p q r " * 30, [("a", b"q r p " * 12 + b"s"), ("b", b"r p q " * 5), ("c", b"p q r"), ("d", b"")]),
    ]
    for text, items in cases:
        n, hit, found = decontaminate.judge(text, decontaminate.Matcher(items))
        want, names = _hits(text, items)
        assert ({i for i in range(n) if hit is not None and hit[i]}, found) == (want, names)


def test_archives_of_a_failed_write_are_not_read(spark, tmp_path):
    path = str(tmp_path / "crawl")
    pages = spark.createDataFrame([(k, f"http://a.org/{k}", f"<p>{k}") for k in range(6)], "page_id long, url string, html string")
    broken = warc.to_records(pages.repartition(3)).withColumn("url", F.when(F.col("page_id") == 5, F.raise_error(F.lit("lost"))).otherwise(F.col("url")))
    warc.register(spark)
    with pytest.raises(Exception, match="lost"):
        broken.write.format("warc").mode("append").save(path)
    left = next(iter((tmp_path / "crawl").glob("*.warc.gz")), None)
    if left is None:  # a file that a lost task has left
        (tmp_path / "crawl" / "part-lost.warc.gz").write_bytes(warc.gzip_member(warc.record("response", 9, "http://b.org", "A" * 32, 1, b"x", None)))
    assert warc.read(spark, path, "page_id long").count() == 0
    warc.archive(pages, path)
    assert sorted(r.page_id for r in warc.read(spark, path, "page_id long").collect()) == list(range(6))
    # Overwriting: what was there stays until the new archives are whole.
    with pytest.raises(Exception, match="lost"):
        broken.write.format("warc").mode("overwrite").save(path)
    assert warc.read(spark, path, "page_id long").count() == 6
    warc.to_records(pages.filter("page_id < 2")).write.format("warc").mode("overwrite").save(path)
    assert sorted(r.page_id for r in warc.read(spark, path, "page_id long").collect()) == [0, 1]
    assert len(list((tmp_path / "crawl").glob("_manifest-*"))) == 1


def test_foreign_archives_stay_when_others_are_added(spark, tmp_path):
    path = tmp_path / "foreign"
    path.mkdir()
    (path / "theirs.warc.gz").write_bytes(warc.gzip_member(warc.record("response", 9, "http://b.org", "A" * 32, 1, b"x", None)))
    pages = spark.createDataFrame([(1, "http://a.org", "<p>")], "page_id long, url string, html string")
    warc.archive(pages, str(path))
    assert sorted(r.page_id for r in warc.read(spark, str(path), "page_id long").collect()) == [1, 9]
    assert {x for p in path.glob("_manifest-*") for x in json.loads(p.read_text())} >= {"theirs.warc.gz"}
