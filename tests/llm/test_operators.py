"""Each operator against brute force on small tables with nulls, empty texts, repeats and clashing columns."""

import base64
import gzip
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import types
from pyspark.sql.datasource import EqualTo

from plain import assert_gapless, classes_of, levels_in_force
from gristmill.llm import chat, common, components, decontaminate, licenses, packing, quality_model, quality_rules, simhash, toxicity, url_filters, warc
from gristmill.llm.queries import ORACLES, URL_RULES, tokenizer_file

LONG = " ".join(f"w{i % 977}x{i}" for i in range(6000))
TEXTS = ["The Quick brown fox jumps over the lazy dog", "the quick brown fox jumps over the lazy dog", None, "", " \n\t ", "a b", LONG, LONG + " end", "x # y $ z | & < >\n" * 5, "one two three four five six seven eight nine " * 4, "É mit license MIT  LICENSE\nReleased under the Apache License", "Licensed under CC BY-NC 4.0."]
DOCS = "doc_id long, text string, lang string, source string, n_words long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", -1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[0], (None, "no id", "en", "s", None)], DOCS).persist()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 1, 1), (None, 1, 1), (3, None, None), (0, 1, 0)], "doc_id long, quality int, toxic int")


def test_components(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 240)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash(docs, spark):
    def brute(text):
        words = (text or "").encode().lower().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    want = {i: f"{brute(t):016x}" for i, t in enumerate(TEXTS)}
    assert all(r.fingerprint == want[r.doc_id] for r in got if r.doc_id is not None)
    by_id = {r.doc_id: r.component_id for r in got}
    assert by_id[0] == by_id[1] == 0 and by_id[2] == by_id[3] == by_id[4] == 2 and by_id[6] == by_id[7] == 6
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("bucket", "size"), [(simhash.BUCKET, 1), (8, 1), (8, (1 << 22) + 1), (simhash.BUCKET, (1 << 31) + 1)])
def test_near_links_of_cut_buckets_and_all_tables(spark, monkeypatch, bucket, size):
    """Buckets cut into parts, and the tables of larger corpora, link what every pair compared does."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    masks = simhash._tables(size)
    assert len(masks) == (4 if size <= 1 << 22 else 10 if size <= 1 << 31 else 20)
    monkeypatch.setattr(simhash, "_tables", lambda n: masks)
    rng = np.random.default_rng(8)
    fps = {int(s) ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for s in rng.integers(0, 1 << 62, 40, dtype=np.uint64) for n in range(6)}
    fps = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    got = simhash.near_links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    near = [(a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= simhash.RADIUS]
    assert classes_of(fps, [(r.a, r.b) for r in got]) == classes_of(fps, near)


def test_one_of_each(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(3000)) for x in "abc")
    rows = [(3, a, 0), (5, a + " end", 1), (5, b, 2), (5, b, 3), (7, b, 4), (None, a, 5), (None, c, 6), (None, c + " end", 7), (None, None, 8), (None, "", 9), (8, "alone", 10), (1, "T", 11), (2, "T", 12), (2, "U", 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    fp = {n: simhash.fingerprint(simhash.shingle_hashes((t or "").encode())) for _, t, n in rows}
    near = [(x, y) for x, y in itertools.combinations(fp, 2) if (int(fp[x]) ^ int(fp[y])).bit_count() <= simhash.RADIUS]
    group = classes_of(fp, near)
    assert group[0] == group[1] == group[5] and group[6] == group[7] and group[11] == group[12] != group[13]
    got = simhash.one_of_each(df).collect()
    assert sorted(group[r.n] for r in got) == sorted(set(group.values()))  # one row of each component, none lost
    for r in got:
        ids = [i for i, _, n in rows if group[n] == group[r.n] and i is not None]
        assert (r.doc_id, r.text) == rows[r.n][:2] and r.doc_id == min(ids, default=None)
    assert simhash.one_of_each(df).columns == df.columns and simhash.one_of_each(df.limit(0)).count() == 0


def test_joins_of_frequent_keys(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(common, "HOT_SHARE", 4)
    rows = spark.createDataFrame([(k, 1 if k % 3 else k) for k in range(40)] + [(99, None)], "id long, key long")
    table = rows.filter("key is not null and key <> 12").groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    want = {(r.id, r.key, r.top) for r in rows.join(table, "key").select("id", "key", "top").collect()}
    assert {(r.id, r.key, r.top) for r in common.spread_join(rows, table, "key", "n", rows.count()).collect()} == want
    salted = common.salted_join(rows, table.select("key", "top"), "key", "left", F.col("id")).select("id", "key", "top").collect()
    assert len(salted) == 41 and {tuple(r) for r in salted if r.top is not None} == want
    assert {r.id for r in common.salted_join(rows, table.select("key"), "key", "left_semi", F.col("id")).collect()} == {i for i, _, _ in want}


def test_bit_sliced_comparison_finds_every_link():
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 62, 150, dtype=np.uint64)
    fps = np.unique(np.array([int(s) ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for s in seeds for n in range(4)], np.uint64))
    a, b = simhash.forest(fps.view(np.int64), np.zeros(len(fps), np.int64), np.zeros(len(fps), np.int64))

    def classes(links):
        label = {int(x): int(x) for x in fps.view(np.int64)}
        changed = True
        while changed:
            changed = False
            for i, j in links:
                m = min(label[i], label[j])
                changed |= label[i] != m or label[j] != m
                label[i] = label[j] = m
        return label

    near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= simhash.RADIUS)
    signed = fps.view(np.int64).tolist()
    assert classes([*zip(a.tolist(), b.tolist(), strict=True)]) == classes([(signed[i], signed[j]) for i, j in near])


def test_quality_rules(docs, labels):
    def repeated(words):
        seen = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        return len({p for k in range(len(words) - 7) if seen[tuple(words[k : k + 8])] > 1 for p in range(k, k + 8)})

    got = quality_rules.judge(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        text = (TEXTS[r.doc_id] if r.doc_id is not None else "no id") or ""
        words = text.encode().split()
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), repeated(words))
        assert r.base_failed == (len(words) < 20 or 100 * repeated(words) > 30 * len(words))
    assert quality_rules.keep_good(docs, labels).columns == docs.columns
    assert {r.doc_id for r in quality_rules.keep_good(docs, labels).collect()} == {r.doc_id for r in got if r.kept}


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(n, k) for n in (1, 10, 500) for k in range(0, 6) if k <= n], "n long, k long").withColumn("p", quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.02)).collect()
    for r in rows:
        assert math.isclose(r.p, sum(math.comb(r.n, i) * 0.02**i * 0.98 ** (r.n - i) for i in range(r.k + 1)), rel_tol=1e-9)


def test_levels_in_force(spark):
    rows = [("en", 6)] * 900 + [("en", 5)] * 3 + [("en", 2)] * 2 + [("en", 1)] * 4 + [("de", 6)] * 216 + [("fr", 6)] * 217 + [("es", 6)] * 500 + [("es", 3)] * 40
    got = {r.stratum: r.in_force for r in quality_rules.select_levels(spark.createDataFrame(rows, "stratum string, level int")).collect()}
    assert got == levels_in_force(rows, quality_rules.ALPHA, quality_rules.DELTA) == {"en": 4, "fr": 5, "es": 2}
    assert quality_rules.select_levels(spark.createDataFrame([], "stratum string, level int")).count() == 0


def test_quality_rules_with_levels_in_force(spark):
    """Cutoffs that pass reject what is above them, and what stands exactly on one stays."""
    clean = [(k, " ".join(f"word{k}x{i}" for i in range(30)), "en") for k in range(260)]
    probes = {}
    for n_symbols in (1, 2, 3):  # of 100 characters in words: 0.01, 0.02 (a cutoff) and 0.03
        words = [f"{chr(97 + i)}bcd" for i in range(25)]
        words[0] = "#" * n_symbols + "abcd"[n_symbols:]
        probes[300 + n_symbols] = " ".join(words)
    df = spark.createDataFrame([*clean, *((i, t, "en") for i, t in probes.items()), (400, probes[303], "de"), (401, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(260)] + [(303, 0), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.judge(df, labels).collect()}
    assert all(got[k].kept for k in range(260))
    assert [got[300 + k].n_symbols for k in (1, 2, 3)] == [1, 2, 3] and got[301].word_chars == 100
    assert [got[300 + k].kept for k in (1, 2, 3)] == [True, True, False] and got[400].kept and got[401].base_failed and not got[401].kept
    assert sorted(r.doc_id for r in quality_rules.keep_good(df, labels).collect()) == sorted(i for i, r in got.items() if r.kept)
    assert quality_rules.keep_good(df.limit(0), labels).count() == 0 == quality_rules.judge(df.limit(0), labels).count()
    assert all(r.kept != r.base_failed for r in quality_rules.judge(df, labels.limit(0)).collect())  # no labels, no level


def test_decontamination(docs, spark):
    bench = spark.createDataFrame([(1, "QUICK, brown fox"), (2, None), (3, " ".join(f"w{i % 977}x{i}" for i in range(100, 120))), (1, "QUICK, brown fox"), (None, "lazy dog")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    assert (got[0].n_words, got[0].n_hit, got[0].n_items, got[0].contaminated) == (9, 5, 1, True)
    assert got[0].items_sha256 == hashlib.sha256(b"1").hexdigest() and got[2].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert (got[6].n_hit, got[6].contaminated) == (20, False)
    spans = [(r.start, r.end) for r in decontaminate.hit_spans(docs.filter("doc_id = 0").limit(1), bench).orderBy("start").collect()]
    assert [TEXTS[0][a:b] for a, b in spans] == ["Quick brown fox", "lazy dog"]
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == {i for i, r in got.items() if not r.contaminated}


def test_windows_found_through_blocks():
    """Texts cut from items, joined and disturbed, against every window compared."""
    rng = np.random.default_rng(12)
    items = [(str(k) if k % 9 else None, " ".join(f"w{int(x)}" for x in rng.integers(0, 12 if k % 2 else 400, int(rng.integers(1, 60)))).encode()) for k in range(60)] + [("r", b"a b " * 30), ("none", b" .,"), ("13", " ".join(map(str, range(13))).encode())]
    matcher = decontaminate.Matcher(items)
    windows = {}
    for item, text in items:
        words = decontaminate.words_of(text)
        n = min(len(words), decontaminate.WINDOW)
        for k in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[k : k + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    for n in range(200):
        parts = []
        for _ in range(int(rng.integers(0, 6))):
            words = decontaminate.words_of(items[int(rng.integers(len(items)))][1])
            i = int(rng.integers(0, len(words) + 1))
            parts += words[i : i + int(rng.integers(1, 40))] + [b"x"] * int(rng.integers(0, 2))
        text = b", ".join(parts) if n else b"A b " * 50
        words = decontaminate.words_of(text)
        want, hit = set(), np.zeros(len(words), bool)
        for size in sizes:
            for k in range(len(words) - size + 1):
                if (ids := windows.get(tuple(words[k : k + size]))) is not None:
                    want |= ids
                    hit[k : k + size] = True
        count, got, met = decontaminate.judge(text, matcher)
        assert count == len(words) and met == want and (hit == (np.zeros(len(words), bool) if got is None else got)).all()


def test_decontamination_bound_and_empty_tables(docs, spark, monkeypatch):
    bench = spark.createDataFrame([(1, "quick brown fox", "en"), (2, "x" * 50, "en")], "item_id long, text string, lang string")
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    for empty in (bench.limit(0), spark.createDataFrame([(1, None), (2, "--")], "item_id long, text string")):
        rows = decontaminate.contamination(docs, empty).collect()
        assert len(rows) == docs.count() and not any(r.n_hit or r.n_items or r.contaminated for r in rows)
        assert decontaminate.drop_contaminated(docs, empty).count() == docs.count()
    monkeypatch.setattr(decontaminate, "MAX_BENCHMARK_BYTES", 64)
    with pytest.raises(ValueError, match="65 bytes"):
        decontaminate.contamination(docs, bench)


def test_packing(docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_file())
    odd = "ﬁ İstanbul é <|endoftext|> don't 12a! 日本 x y"
    encoder = packing.Encoder(open(tokenizer_file(), encoding="utf-8").read())
    for t in [*TEXTS, odd]:
        assert np.frombuffer(encoder.encode((t or "").encode()), "<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids
    got = packing.pack_documents(docs, tokenizer_file()).collect()
    want = Counter()
    for row in docs.collect():
        ids = [*whole.encode(row.text or "", add_special_tokens=False).ids, packing.END_ID]
        for k in range(0, len(ids), packing.CAPACITY):
            part = np.array(ids[k : k + packing.CAPACITY], "<u4").tobytes()
            want[row.doc_id, k // packing.CAPACITY, k, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert_gapless(got)
    assert packing.pack_documents(docs.limit(0), tokenizer_file()).collect() == []
    texts = {r.doc_id: r.ids for r in packing.pieces(docs.filter("doc_id in (0, 3)"), tokenizer_file(), with_ids=True).collect()}
    assert texts == {0: [*whole.encode(TEXTS[0], add_special_tokens=False).ids, 0], 3: [0]}


def test_texts_are_encoded_together_and_each_chunk_is_looked_at_once(monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_file())
    texts = [*(t or "" for t in TEXTS), "", " \t\n", "ﬁ İstanbul é <|endoftext|> don't 12a! 日本 x y", "", "the same, the same", "same the"] * 3
    batches = [pa.record_batch([pa.array([t.encode() for t in texts[k : k + 5]], pa.binary())], ["body"]) for k in range(0, len(texts), 5)]
    want = [[*whole.encode(t, add_special_tokens=False).ids, packing.END_ID] for t in texts]
    for n_bytes, n_ids in ((1, 1), (40, 7), (8_000_000, 1_000_000)):
        monkeypatch.setattr(packing, "RUN_BYTES", n_bytes)
        monkeypatch.setattr(packing, "RUN_IDS", n_ids)
        encoder = packing.Encoder(open(tokenizer_file(), encoding="utf-8").read())
        runs = [r.column("body").combine_chunks() for r in packing.runs_of(iter(batches))]
        assert [ids.tolist() for r in runs for ids in encoder.encode_all(r)] == want
        assert all(len(r) == 1 or sum(map(len, r.to_pylist())) <= n_bytes for r in runs)
    seen = Counter()
    monkeypatch.setattr(encoder, "parts", type("Seen", (dict,), {"__getitem__": lambda self, p: seen.update([p]) or encoder._part(p), "turn": lambda self: None})())
    list(encoder.encode_all(pa.array([b"alpha beta alpha"] * 50, pa.binary())))
    assert seen == {"alpha": 1, "beta": 1, "\n": 2}


def test_packing_keeps_large_ids_beside_null_ones(spark):
    large = 9007199254740993  # no double has this value
    df = spark.createDataFrame([(large, "a b c"), (None, "d"), (large, "a b c")], "doc_id long, text string").coalesce(1)
    got = packing.pack_documents(df, tokenizer_file()).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == [str(large), str(large), "None"]
    assert len({(r.sequence_id, r.offset) for r in got}) == 3
    assert_gapless(got)


def histograms():
    rng = np.random.default_rng(5)

    def counted(lengths):
        return dict(Counter(min(2048, max(1, int(x))) for x in lengths))

    yield {int(s): int(n) for s, n in zip(rng.integers(1, 2049, 600), rng.integers(1, 400, 600), strict=True)}
    yield counted(rng.integers(1, 2049, 222))
    yield counted(rng.integers(400, 1100, 20_000))
    yield counted(rng.integers(1, 60, 300))
    yield counted(rng.lognormal(6, 1, 4000))
    yield {300: 1000, 700: 900, 1100: 800, 650: 333}
    yield {2048: 5}
    yield {1: 1}
    yield {}


@pytest.mark.parametrize("histogram", list(histograms()))
def test_packing_plan_is_whole_and_tight(histogram):
    planned, held = packing.plan(histogram), Counter()
    for n, content in planned:
        assert sum(s * k for s, k in content) <= 2048
        for s, k in content:
            held[s] += n * k
    assert held == Counter(histogram)
    needed = sum(n for n, _ in planned)
    assert -(-sum(s * n for s, n in histogram.items()) // 2048) <= needed <= sum(n for n, _ in packing._best_fit([], histogram, 2048))


def test_knapsack_finds_the_best_configuration():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes, prices, room = rng.integers(3, 40, 6), rng.random(6), 60
        worth = [0.0] * (room + 1)
        for c in range(1, room + 1):
            worth[c] = max([worth[c - 1], *(p + worth[c - s] for s, p in zip(sizes, prices, strict=True) if s <= c)])
        found = packing.best_configuration(sizes, prices, room)
        assert sum(n * sizes[k] for k, n in found) <= room and math.isclose(sum(n * prices[k] for k, n in found), worth[room])


def test_licenses(docs):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    r = got[10]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (10, 3, 1, 8, "apache,mit")
    assert got[11].labels == "cc-by-nc" and got[2].n_words == 0 and got[2].first_word is None and got[0].labels == ""


def test_licenses_over_line_ends(spark):
    wrapped = [
        "Intro.\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\")",
        "# The above copyright notice and this permission notice shall be included in\n# all copies or substantial portions of the Software.",
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
        "Permission to use, copy, modify, and/or distribute this software for any\ndnl purpose with or without fee is hereby granted, provided",
        " * This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0.",
        "this is free\n" + "word " * 40 + "\nand unencumbered software released into the public domain",
        "this is free free free free free free free free and unencumbered software\nreleased into the public domain",
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(wrapped)), "doc_id long, text string")).collect()}
    for i, text in enumerate(wrapped):
        words, best = re.findall("[a-z0-9]+", text.lower()), {}
        for label, template in licenses.TEMPLATES:
            n, ws = len(template.split()), set(template.split())
            blocks = [re.findall("[a-z0-9]+", x) for x in text.lower().split("\n")] + [words[k : k + n] for k in range(len(words))]
            share = max(len(ws & set(b)) / len(ws) for b in blocks)
            if share >= 0.8:
                best[label] = max(share, best.get(label, 0.0))
        assert (got[i].labels, got[i].score) == (",".join(sorted(best)), max(best.values(), default=0.0)), text
    assert [got[i].labels for i in range(7)] == ["mit", "mit", "bsd", "isc", "mpl", "", "unlicense"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(wrapped)))
    assert {r[0]: (r[6], r[7]) for r in con.execute(ORACLES["op5_license_scans"]).fetchall()} == {i: (r.labels, r.score) for i, r in got.items()}
    twice = spark.createDataFrame([(1, wrapped[0], 5), (1, wrapped[0], 5), (2, None, 6)], "doc_id long, text string, n_words long")
    assert [(r.doc_id, r.labels) for r in licenses.scan(twice).orderBy("doc_id").collect()] == [(1, "mit"), (1, "mit"), (2, "")]
    assert licenses.scan(twice.limit(0)).count() == 0


def counted(text):
    return len(re.findall(r"[A-Za-z]{1,3}|[0-9]|[!-/:-@\[-`{-~]", text)) + sum(len(c.encode()) for c in text if c > "\x7f") + chat.OVERHEAD


def windows_of(turns, budget, history):
    """(role, text, again) of each window of a conversation's turns, in plain Python."""
    sizes = [counted(x) for _, x in turns]
    has = bool(turns) and turns[0][0] == "system" and sizes[0] <= budget // 4
    room, at, out, chunk, start = budget - history - (sizes[0] if has else 0), sizes[0] if has else 0, [], None, 0
    places = []
    for k in range(int(has), len(turns)):
        if not out or at // (chat.CHUNK * budget) != chunk or at + sizes[k] - start > room:
            back = [turns[j] for j, p in places if p >= at - history] if sizes[k] <= room else []
            out.append([(r, x, True) for r, x in back])
            chunk, start = at // (chat.CHUNK * budget), at
        out[-1].append((*turns[k], False))
        places.append((k, at))
        at += sizes[k]
    return [([(*turns[0], i > 0)] if has else []) + w for i, w in enumerate(out or [[]])]


@pytest.mark.parametrize(("budget", "history"), [(chat.BUDGET, chat.HISTORY), (120, 40), (64, 0)])
def test_chat(spark, budget, history):
    rng, said = np.random.default_rng(4), "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said), (1, 0, "system", "be &amp; <b>"), (None, 0, "user", None), (2, 0, "system", "only"), (3, 0, "system", "long " * 700), (3, 1, "user", "x")]
    rows += [(1, k, "assistant" if k % 2 == 0 else "user", f"turn {k} " + "word " * int(rng.integers(0, 330))) for k in range(1, 60)]
    rows += [(4, k, "assistant", "日本é " * int(rng.integers(0, 9))) for k in range(300)] + [(4, 100, "user", "y" * 70_000), (5, None, None, "a"), (5, 1, "user", "b"), (5, 1, "user", "b"), (6, 0, "assistant", "&lt;<|turn|>&amp;")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, window string").repartition(5)
    made = chat.format_windows(df, budget, history)
    by_conv = {}
    for r in sorted(made.collect(), key=lambda r: r.window):
        by_conv.setdefault(r.conv_id, []).append(r)
    for conv, got in by_conv.items():
        turns = [(r or "", x or "") for _, r, x in sorted(((-1 if k is None else k, r or "", x or "") for c, k, r, x in rows if c == conv))]
        want = windows_of(turns, budget, history)
        assert len(got) == len(want)
        for r, w in zip(got, want, strict=True):
            text, spans = "", []
            for role, x, again in w:
                role, x = (v.replace("&", "&amp;").replace("<", "&lt;").replace("[", "&#91;") for v in (role, x))
                text += (chat.AGAIN if again else chat.TURN) + role + chat.TEXT
                if role == "assistant" and not again:
                    spans.append((len(text), len(x)))
                text += x + chat.END
            assert r.text == text and [tuple(s) for s in r.loss] == spans and r.tokens == sum(counted(x) for _, x, _ in w)
            new = sum(not again for _, _, again in w)
            new -= new > 1 and w[0][0] == "system"
            assert r.tokens <= budget or new == 1 and not any(again and i for i, (_, _, again) in enumerate(w))  # only a turn that is too long by itself
    assert {c for c, *_ in rows} == set(by_conv)
    for r in chat.digests(made).collect():
        turns = [x for x in sorted(((-1 if k is None else k, r2 or "", x or "") for c, k, r2, x in rows if c == r.conv_id))]
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest()
        assert r.formatted_chars == sum(len(w.text) for w in by_conv[r.conv_id])
    assert chat.digests(chat.format_windows(df.limit(0), budget, history)).count() == 0


def test_url_filters(spark):
    link = '<html><link href="{}" rel="canonical">'
    rows = [(0, "http://a.example.com/en/1", None), (1, "https://b.org/x", link.format("http://a.example.com/en/1")), (2, "http://EXAMPLE.com/en/7?q", ""), (3, "x.de/y", ""), (4, None, ""), (5, "http://c.org/y#f", link.format("//b.org/x")), (6, "http://d.org/z", '<meta content="0; url=http://s.example.com/en/77" http-equiv=refresh>')]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), URL_RULES).collect()}
    assert got == {0: ("a.example.com", "/en/1", "com/en/", "block"), 1: ("b.org", "/x", None, "block"), 2: ("example.com", "/en/7", "example.com/en/7", "allow"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("c.org", "/y", None, "block"), 6: ("d.org", "/z", None, "allow")}


def test_url_filters_reads_whole_refresh_targets(spark):
    meta = "<html><meta http-equiv='refresh' content={}>"
    contents = {
        "http://b.org/es/?a=1&b=2": '"0; url=http://b.org/es/?a=1&amp;b=2"',
        "http://b.org/es/x;v=2": '"5;URL=http://b.org/es/x;v=2"',
        "http://b.org/es/inner": "\"0; url='http://b.org/es/inner'\"",
        "http://b.org/es/other": "'0; url = \"http://b.org/es/other\" '",
        "http://b.org/es/unquoted": "0;url=http://b.org/es/unquoted",
        "http://b.org/es/no-time": '"url=http://b.org/es/no-time"',
        "http://b.org/es/no-name": '"0; http://b.org/es/no-name"',
        "http://b.org/es/é?c='d'": '"0; url=http://b.org/es/&#233;?c&#x3D;&#39;d&apos;"',
        "http://b.org/es/?a=&lt;": '"0; url=http://b.org/es/?a=&amp;lt;"',
    }
    rows = [(k, f"http://from{k}.test/", meta.format(c)) for k, c in enumerate(contents.values())]
    pages = spark.createDataFrame([*rows, (99, "http://clean.test/", meta.format('"30"'))], "page_id long, url string, html string")
    assert {(r.a, r.b) for r in url_filters.page_links(pages).collect()} == {(f"from{k}.test/", u.removeprefix("http://")) for k, u in enumerate(contents)}
    got = {r.page_id: r.verdict for r in url_filters.judge(pages, URL_RULES).collect()}
    assert got == {**{k: "block" for k in range(len(contents))}, 99: "allow"}


def test_url_filters_takes_every_link_of_a_page(spark):
    canonical, refresh = "<link rel={} href={}>".format, "<meta http-equiv=Refresh content='0;url={}'>".format
    html = {
        "http://a.test/d/e/p?x=1": "".join([canonical("canonical", "http://b.test/1"), "<meta charset=utf-8>", canonical('"nofollow canonical"', "'http://b.test/2'"), refresh("http://b.test/3"), refresh("http://b.test/4"), '<link title="a > rel=canonical" data-href="http://c.test/" rel="icon" href="/icon">']),
        "http://q.test/d/p?x=1#f": canonical("canonical", '"?page=1"') + refresh("?page=2"),
        "http://r.test/d/e/p": canonical("canonical", "../x") + canonical("canonical", "./y/") + canonical("canonical", "/a/../../z/.") + refresh("..") + canonical("canonical", "' http://r.test/a b\n'") + canonical("canonical", "mailto:x@y") + canonical("canonical", "#f"),
        "http://s.test/u/../v": canonical("canonical", '"http://s.test/w>1"'),
        "http://t.test": canonical("canonical", "x/../y"),
        "http://z.test/": refresh("http://quiet.test/") + refresh("http://b.org/es/1") + refresh("http://b.org/es/2"),
    }
    want = {("a.test/d/e/p?x=1", f"b.test/{k}") for k in range(1, 5)} | {("q.test/d/p?x=1", f"q.test/d/p?page={k}") for k in (1, 2)}
    want |= {("r.test/d/e/p", f"r.test/{x}") for x in ("d/x", "d/e/y/", "z/", "d/", "a b")} | {("s.test/v", "s.test/w>1"), ("t.test", "t.test/y")}
    want |= {("z.test/", x) for x in ("quiet.test/", "b.org/es/1", "b.org/es/2")}
    pages = spark.createDataFrame([*((k, u, h) for k, (u, h) in enumerate(html.items())), (9, "http://quiet.test/", "")], "page_id long, url string, html string")
    assert {(r.a, r.b) for r in url_filters.page_links(pages).filter("b is not null").collect()} == want
    blocked = {r.page_id for r in url_filters.judge(pages, URL_RULES).filter("verdict = 'block'").collect()}
    assert blocked == {5, 9}  # joined through the first refresh of 5, blocked through the others


def test_rules_in_an_expression_and_in_a_join_choose_alike(spark, monkeypatch):
    rng = np.random.default_rng(6)
    hosts, paths = ["com", "a.com", "b.a.com", "xa.com", "net", "a.net", ""], ["", "/", "/x", "/xy", "/xy/z", "/y"]
    urls = [f"http://{'S.' if k % 5 == 0 else ''}{h}{p}?q" for k, (h, p) in enumerate(itertools.product(hosts, paths))] + ["http://a.com/xy", None, "no url", "http://h\nx/ y"]
    rules = [url_filters.Rule(["allow", "block"][int(rng.integers(2))], hosts[int(rng.integers(6))], paths[int(rng.integers(1, 6))]) for _ in range(40)]
    rules += [url_filters.Rule("block", "a.com", "/"), url_filters.Rule("block", "com", "/xy"), url_filters.Rule("allow", "com", "/xy")]
    rows = url_filters.with_parts(spark.createDataFrame([(k, u) for k, u in enumerate([*urls, *urls[:9]])], "k long, url string"), "url")

    def best(host, path):
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return min(((-len(r.name), r.verdict != "allow", r.name, r.verdict) for r in fits), default=(None,) * 4)[2:]

    inline = url_filters.with_rule(rows, rules).collect()
    monkeypatch.setattr(url_filters, "MAX_INLINE", 0)
    joined = url_filters.with_rule(rows, rules).collect()
    for got in (inline, joined):
        assert {r.k: tuple(r.fit) if r.fit else (None, None) for r in got} == {r.k: best(r.host, r.path) for r in rows.collect()} and len(got) == len(urls) + 9


@pytest.mark.parametrize("hot", [1000, 3])
def test_url_filters_over_a_graph_with_hubs(spark, monkeypatch, hot):
    """A generated graph with hubs, chains, repeated and null pages, against a search in plain Python."""
    monkeypatch.setattr(common, "HOT_SHARE", hot)
    rng = np.random.default_rng(9)
    urls = [f"http://h{k % 37}.{('com', 'net', 'org', 'example.net', 'test')[k % 5]}/{('en', 'de', 'es')[k % 3]}/{k}" for k in range(400)]
    hubs = [(0, k) for k in range(1, 120)] + [(k, 150) for k in range(151, 200)]
    chain = [(k, k + 1) for k in range(210, 260)]
    links = hubs + chain + [tuple(map(int, x)) for x in rng.integers(260, 400, (60, 2))]
    html = {k: "" for k in range(400)}
    given = []
    for n, (a, b) in enumerate(links):
        if n % 3 == 0:
            given.append((urls[a], urls[b]))
        else:
            html[a] += f"<link rel=canonical href='{urls[b]}'>" if n % 3 == 1 else f"<meta http-equiv=refresh content='0; url={urls[b]}'>"
    rows = [(k, urls[k], html[k]) for k in range(400)] + [(k, urls[5], None) for k in range(1000, 1040)] + [(None, None, "x"), (2000, None, None), (2000, None, None), (2001, "nothing", html[0])]
    redirects = spark.createDataFrame([*given, (None, urls[3]), (urls[3], None)], "source string, target string")
    got = url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), URL_RULES, redirects).collect()
    assert len(got) == len(rows)
    classes = classes_of(range(400), links)

    def fits(u):
        host, path = re.match("http://([^/]*)(.*)", u).groups()
        best = max(((len(r.name), r.verdict == "allow", r) for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)), key=lambda x: x[:2], default=None)
        return best and best[2].verdict

    verdicts = {}
    for k, root in classes.items():
        verdicts.setdefault(root, set()).add(fits(urls[k]))
    for r in got:
        k = r.page_id if r.page_id is not None and r.page_id < 400 else 5 if r.host else None
        of = verdicts[classes[k]] if k is not None else set()
        assert r.verdict == ((fits(urls[k]) if k is not None else None) or ("block" if "block" in of and "allow" not in of else "allow"))
    assert url_filters.judge(spark.createDataFrame([], "page_id long, url string, html string"), URL_RULES).count() == 0


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/ b", "<p>é</p>"), (2, None, None), (3, "http://c", "<p>é</p>"), (4, "http://d", ""), (None, "http://e", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    for i, _, html in rows:
        payload = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
    assert [(got[i].record_type, got[i].refers_to) for i in (1, 2, 3, 4, None)] == [("response", None), ("response", None), ("revisit", 1), ("revisit", 2), ("response", None)]
    path = str(tmp_path / "w")
    warc.archive(pages, path)
    back = warc.read(spark, path, "page_id long, record_type string, payload binary").filter("record_type = 'response'")
    assert {r.page_id: bytes(r.payload) for r in back.collect()} == {i: (h or "").encode() for i, _, h in rows if i not in (3, 4)}


def test_warc_reads_any_member_layout(tmp_path):
    """Records of one gzip member, of a member for each, of named members, of skip lengths and of no compression are all read."""
    bodies = [b"", b"<p>x</p>", b"y" * 200_000, "é\r\n\r\nz".encode(), b"end"]
    urls = ["http://a/", "http://a/ b%20c", "http://é/\n", None, "http://a/%C3%A9?x=1"]
    raw = [warc.record("revisit" if k == 4 else "response", k, urls[k], warc.digest_of(b), len(b), None if k == 4 else b, 0 if k == 4 else None) for k, b in enumerate(bodies)]

    def named(data):
        packed = gzip.compress(data)
        return packed[:3] + bytes([8 | 16 | 2]) + packed[4:10] + b"name\0a comment\0xx" + packed[10:]

    layouts = {
        "one": gzip.compress(b"".join(raw)),
        "each": b"".join(map(gzip.compress, raw)),
        "named": b"".join(map(named, raw)),
        "skips": b"".join(map(warc.gzip_member, raw)),
        "mixed": gzip.compress(raw[0] + raw[1]) + warc.gzip_member(raw[2]) + named(raw[3] + raw[4]),
        "plain": b"".join(raw),
    }
    for name, data in layouts.items():
        at = tmp_path / f"{name}.warc.gz"
        at.write_bytes(data)
        for how in ("block", "http", "headers"):
            got = list(warc.records(str(at), lambda h, how=how: how))
            assert [warc.value_of("page_id", h) for h, _ in got] == [0, 1, 2, 3, 4], (name, how)
            assert [warc.value_of("url", h) for h, _ in got] == urls
            if how == "block":
                assert [b.partition(b"\r\n\r\n")[2] for _, b in got] == [*bodies[:4], b""]
        assert [warc.value_of("page_id", h) for h, _ in warc.records(str(at), lambda h: "block" if h["WARC-Type"] == "revisit" else "")] == [4]
    (tmp_path / "cut.warc.gz").write_bytes(layouts["one"][:-300])
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records(str(tmp_path / "cut.warc.gz"), lambda h: "block"))


def test_warc_skips_what_is_not_wanted(tmp_path, monkeypatch):
    """With a pushed record type, nothing but the beginning of other records is decompressed."""
    import random

    noise = random.Random(1)
    raw = [warc.record("response", k, None, "", 400_000, noise.randbytes(400_000), None) for k in range(10)] + [warc.record("revisit", 10, None, "", 400_000, None, 0)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(warc.gzip_member, raw)))
    inflated = []

    class Counted(warc._Inflated):
        def readinto(self, into):
            n = super().readinto(into)
            inflated.append(n)
            return n

    monkeypatch.setattr(warc, "_Inflated", Counted)
    reader = warc.WarcReader(types.StructType.fromDDL("page_id long, payload_bytes long, record_type string"), {"path": str(tmp_path / "a.warc.gz")})
    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), EqualTo(("payload_bytes",), 1)])) == [EqualTo(("payload_bytes",), 1)]
    (part,) = reader.partitions()
    rows = [r for b in reader.read(part) for r in b.to_pylist()]
    assert rows == [{"page_id": 10, "payload_bytes": 400_000, "record_type": "revisit"}] and sum(inflated) < 11 * 8192
    inflated.clear()
    lengths = warc.WarcReader(types.StructType.fromDDL("payload_bytes long"), {"path": str(tmp_path / "a.warc.gz")})
    assert [r["payload_bytes"] for b in lengths.read(part) for r in b.to_pylist()] == [400_000] * 11 and sum(inflated) < 11 * 8192


def test_warc_stores_and_urls(spark, tmp_path):
    assert [warc.uri_of(x) for x in ("s3a://b/k", "s3n://b/k", "s3://b/k", "file:/s3a://x")] == ["s3://b/k"] * 3 + ["file:/s3a://x"]
    urls = ["http://a/ b", "http://a/%20", "http://é/", "x", "", None]
    pages = spark.createDataFrame([(k, u, "h", 1) for k, u in enumerate(urls)], "page_id long, url string, html string, payload int")
    warc.archive(pages, str(tmp_path / "w"))
    back = warc.read(spark, str(tmp_path / "w"), "page_id long, url string")
    assert {r.page_id: r.url for r in back.collect()} == dict(enumerate(urls))
    assert [r.page_id for r in back.filter("url = 'http://a/ b'").collect()] == [0]
    assert warc.round_trip(pages.limit(0)).count() == 0
    twice = warc.round_trip(pages.unionByName(pages.filter("page_id = 3"))).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in twice) == [(0, "response", None), *((k, "revisit", 0) for k in (1, 2, 3, 3, 4, 5))]


def test_toxic_field():
    sample = [(k % 2, (f"word{k} other{k % 7} thing " * 6 + ("vilething here" if k % 2 else "")).encode()) for k in range(120)]
    model = toxicity.fit(sample)
    assert model.score(b"some vilething text") > 0.5 > model.score(b"some other text") and model.score(b"") < 0.5
    assert [("x vilething"[a:b]) for a, b, _ in model.judge(b"x vilething")[1]] == ["vilething"]
    field = toxicity.Field({b"=p": 3.0, b"=q": 2.5}, -2.0, ((0.3, -0.2), (0.1, 0.5)))
    words = [b"aa", b"p", b"zz", b"zy", b"q", b"x"]

    def weight(states):
        return math.exp(sum(s * (field.bias + field._evidence(w)) + (field.trans[states[k - 1]][s] if k else 0) for k, (w, s) in enumerate(zip(words, states, strict=True))))

    every = list(itertools.product((0, 1), repeat=len(words)))
    at, p = field.marginals(words)
    assert np.allclose(p, [sum(weight(s) for s in every if s[i]) / sum(map(weight, every)) for i in at])


@pytest.fixture(scope="module")
def marked(spark):
    """Documents and labels that both classifiers can learn from, beside nulls, empty, very long and repeated rows."""
    said = [f"Good wörds number {k} and other{k % 7} things of the day " * 8 + ("with a Vilething, vilething here $$$ ### " * 3 if k % 2 else "") for k in range(160)]
    rows = [(k, t, "en", 9) for k, t in enumerate(said)]
    rows += [(200, None, None, 1), (201, "", "en", 2), (202, said[1], "en", 3), (202, said[1], "en", 3), (203, "plain " * 200_000 + "Ünd vilething vilething", "en", 4), (None, said[2], "en", 5), (1 << 53 | 1, "a b", "en", 6)]
    labels = [(k, (k + 1) % 2, k % 2) for k in range(160)] + [(5, None, None), (None, 1, 1), (7, 0, 1), (203, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score long").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def fold(doc_id, n):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def test_toxicity_on_tables(spark, marked):
    docs, labels = marked
    held = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    wanted = {r.doc_id: max(y for x, _, y in labels.collect() if x == r.doc_id and y is not None) for r in labels.filter("toxic is not null and doc_id is not null").collect() if fold(r.doc_id, 5) != 0}
    model = toxicity.fit([(wanted[i], held[i]) for i in sorted(wanted)])  # fewer rows than the sample takes: all of them
    got = toxicity.score(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    for r in got:
        score, spans = model.judge(held[r.doc_id])
        assert math.isclose(r.score, score, rel_tol=1e-9) and r.predicted == (r.score >= 0.5) and r.held_out == (fold(r.doc_id, 5) == 0)
        assert [(s.start, s.end) for s in r.spans] == [s[:2] for s in spans]
        text = held[r.doc_id].decode()
        assert all("vilething" in text[s.start : s.end].lower() for s in r.spans)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[k].predicted == k % 2 for k in range(160)) and by_id[203].predicted == by_id[202].predicted == 1
    assert by_id[200].score == by_id[201].score < 0.5
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.score < 0.5)
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.drop_toxic(docs, labels.filter("toxic = 1")).count() == docs.count()


def test_quality_model_on_tables(spark, marked):
    docs, labels = marked
    held = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    wanted = {r.doc_id: max(y for x, y, _ in labels.collect() if x == r.doc_id and y is not None) for r in labels.filter("quality is not null and doc_id is not null").collect() if fold(r.doc_id, 3) != 1}
    kinds = Counter(wanted.values())
    model = quality_model.fit([(wanted[i], held[i]) for i in sorted(wanted)], (kinds[0], kinds[1]))
    got = quality_model.score(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    for r in got:
        assert math.isclose(r.score, model.score(held[r.doc_id]), rel_tol=1e-9)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (fold(r.doc_id, 3) == 1)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[k].predicted == (k + 1) % 2 for k in range(160))
    assert quality_model.score(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality_model.score(docs, labels.limit(0)).collect()} == {0.5}
    only = {r.score for r in quality_model.score(docs, labels.filter("quality = 1")).collect()}
    assert len(only) == 1 and only.pop() > 0.5


def test_factorisation_machine():
    sample = [(k % 2, ((f"good words number {k} " if k % 2 else f"$$$ ### {k} %%% ") * 10).encode()) for k in range(80)]
    model = quality_model.fit(sample, (40, 40))
    assert all((model.score(t) >= 0.5) == (y == 1) for y, t in sample)
    at, x = quality_model.features(b"one two")
    brute = model.w0 + float(model.w[at] @ x) + sum(float(model.v[at[i]] @ model.v[at[j]]) * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert math.isclose(model.margin(b"one two"), brute)
    assert 0 <= quality_model.fit([], (0, 0)).score(b"") <= 1
