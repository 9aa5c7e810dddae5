"""The corpus pipeline, stage by stage, against plain Python over the same small tables."""

import itertools
import zlib
from collections import Counter

import numpy as np
from plain import assert_gapless, classes_of, levels_in_force
from tokenizers import Tokenizer

import corpus_pipeline
from gristmill.llm import common, decontaminate, packing, quality_rules, simhash, toxicity
from gristmill.llm.queries import tokenizer_file


BENCH = [(1, " ".join(f"question{k}" for k in range(30))), (2, "short item")]


def tables():
    rng = np.random.default_rng(21)

    def prose(n):
        return " ".join(f"w{int(x)}" for x in rng.integers(0, 4000, n))

    texts = [prose(60) for _ in range(420)]
    texts += [t + " more" for t in texts[:3]] + [texts[4]] * 3 + [prose(1200)] * 2
    texts += [prose(30) + " " + BENCH[0][1] + " " + prose(30), "a short item " + prose(25), prose(400) + " short item", BENCH[0][1] + " tail"]
    texts += [None, "", "few words", "again and again " * 40, "$$$ ### " * 30 + prose(20), prose(3000)]
    rows = [(k, t, "de" if k % 7 == 0 else "en", "s", 0, "extra") for k, t in enumerate(texts)]
    labels = [(k, 1, 0) for k in range(400)]
    for k in range(500, 560):
        rows.append((k, prose(25) + " vilething bad " + prose(25), "en", "s", 0, "extra"))
        labels.append((k, 0, 1))
    rows += [(None, texts[5], "en", "s", 0, "x"), rows[9], (9, prose(40), None, "s", 0, "x")]
    return rows, labels


def numbered(rows):
    return Counter((r[0], r[1]) for r in rows)


def test_stages_and_run(spark, tmp_path):
    rows, labels = tables()
    schema = "doc_id long, text string, lang string, source string, n_chars long, more string"
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    def after(name):
        nonlocal docs
        docs = common.materialise(stage[name](spark, docs, str(tmp_path)), name)
        return docs.collect()

    of = {k: y for k, _, y in labels if zlib.crc32(str(k).encode()) % toxicity.FOLDS != toxicity.HELD_OUT}
    texts = {}
    for r in rows:  # an id that stands twice is learnt from its least text
        if r[0] in of:
            texts[r[0]] = min(texts.get(r[0], r[1]), r[1])
    model = toxicity.fit([(of[i], texts[i].encode()) for i in sorted(of)])
    rows = [r for r in rows if model.score((r[1] or "").encode()) < 0.5]
    assert numbered(after("toxicity")) == numbered(rows) and not any(500 <= (r[0] or 0) < 560 for r in rows)
    assert docs.columns == [c.split()[0] for c in schema.split(", ")]

    def judged(text):
        text = text or ""
        words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
        seen = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        repeat = len({p for k in range(len(words) - 7) if seen[tuple(words[k : k + 8])] > 1 for p in range(k, k + 8)})
        held = sum(map(len, words))
        share = {
            "symbols": sum(c in "#*$%&|<>" for c in text) / held if held else 0,
            "dup_lines": (len(lines) - len(set(lines))) / len(lines) if lines else 0,
            "repeats": repeat / len(words) if words else 0,
            "capitals": sum("A" <= c <= "Z" for c in text) / held if held else 0,
            "word_length": held / len(words) if words else 0,
        }
        level = next((k for k in range(quality_rules.N_LEVELS) if any(v > quality_rules.LEVELS[r][k] for r, v in share.items())), quality_rules.N_LEVELS)
        return len(words) < 20 or 100 * repeat > 30 * len(words), level

    good = {k for k, y, _ in labels if y}
    verdicts = [judged(r[1]) for r in rows]
    force = levels_in_force([(r[2] or "", v[1]) for r, v in zip(rows, verdicts, strict=True) if r[0] in good], quality_rules.ALPHA, quality_rules.DELTA)
    assert force
    rows = [r for r, (failed, level) in zip(rows, verdicts, strict=True) if not failed and level > force.get(r[2] or "", -1)]
    assert numbered(after("quality_rules")) == numbered(rows)

    fps = [simhash.fingerprint(simhash.shingle_hashes((r[1] or "").encode())) for r in rows]
    group = classes_of(range(len(rows)), [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (fps[a] ^ fps[b]).bit_count() <= simhash.RADIUS])
    got = after("simhash_near_dedup")
    member = {(r[0], r[1]): group[k] for k, r in enumerate(rows)}
    assert sorted(member[r.doc_id, r.text] for r in got) == sorted(set(group.values())) and len(set(group.values())) < len(rows)
    for r in got:
        ids = [x[0] for k, x in enumerate(rows) if group[k] == member[r.doc_id, r.text]]
        assert r.doc_id == min((i for i in ids if i is not None), default=None)
    rows = [tuple(r) for r in got]

    windows = []
    for _, text in BENCH:
        words = decontaminate.words_of(text.encode())
        n = min(len(words), decontaminate.WINDOW)
        windows += [words[k : k + n] for k in range(len(words) - n + 1)]

    def contaminated(text):
        words, hit = decontaminate.words_of((text or "").encode()), set()
        for w in windows:
            for k in range(len(words) - len(w) + 1):
                if words[k : k + len(w)] == w:
                    hit.update(range(k, k + len(w)))
        return bool(hit) and decontaminate.HIT_SHARE * len(hit) >= len(words)

    left = [r for r in rows if not contaminated(r[1])]
    assert numbered(after("benchmark_decontamination")) == numbered(left) and len(left) < len(rows)

    tokenizer, want = Tokenizer.from_file(tokenizer_file()), Counter()
    for r in left:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, packing.END_ID]
        for k in range(0, len(ids), packing.CAPACITY):
            part = np.array(ids[k : k + packing.CAPACITY], "<u4").tobytes()
            want[r[0], k // packing.CAPACITY, k, len(part) // 4, zlib.crc32(part)] += 1
    packed = after("best_fit_packing")
    pieces = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed)
    assert pieces == want
    assert_gapless(packed)

    mark = common.written_so_far(spark)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole) == want
    assert common.written_so_far(spark) == mark + 1  # of all that was written on the way, the result is left


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
