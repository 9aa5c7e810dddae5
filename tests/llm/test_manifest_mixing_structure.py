"""Merkle manifest, mixing and structure repair against plain Python, on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from gristmill.llm import merkle, mixing, queries, ranges, structure
from gristmill.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, at long, tree string, row int, n string"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def documents(n=700):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(40))), rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "a", "a", "b", "é", None]), rng.choice([None, 7, i])) for i in range(n)]
    rows += [rows[3], rows[3], (None, None, None, None, None), (None, "x", "en", "b", 1), (5, "another text of five", "de", "c", 2), (10**12, "long word " * 30_000, "en", "a", -1), (11, "", "zz", "empty", 0)]
    return [(*r, 1, "t", 2, "n") for r in rows]


def leaf(r, forged=False):
    i, text, lang, source, n = r[:5]
    n = n + 1 if forged and n is not None else n
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def climbed(nodes, fan):
    """All levels over these nodes."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fan])) for i in range(0, len(levels[-1]), fan)])
    return levels


def proof(levels, i, fan, h):
    """(siblings, root) of the i-th leaf, folded from h in its place."""
    out = []
    for level in levels[:-1]:
        run = level[i // fan * fan : (i // fan + 1) * fan]
        out += run[: i % fan] + run[i % fan + 1 :]
        h = sha("".join(run[: i % fan] + [h] + run[i % fan + 1 :]))
        i //= fan
    return out, h


def plain_manifest(rows, fan):
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    own = {k: climbed([x[2] for x in sorted(trees[k], key=lambda x: x[:3])], fan) for k in names}
    over = climbed([own[k][-1][0] for k in names], fan)
    out = []
    for j, k in enumerate(names):
        for i, (_, _, h, r) in enumerate(sorted(trees[k], key=lambda x: x[:3])):
            tampered = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            low, folded = proof(own[k], i, fan, leaf(r, True) if tampered else h)
            high, folded = proof(over, j, fan, folded)
            out.append((r[0], h, own[k][-1][0], over[-1][0], "".join(low + high), folded))
    return out


@pytest.mark.parametrize("fan, depth", [(2, 3), (3, 2), (2, 8)])
def test_merkle_against_plain(spark, fan, depth):
    rows = documents(150 if depth == 2 else 700)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    changed = merkle.digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")])
    forged = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.when(F.col("n_chars").isNotNull(), changed))
    manifest = merkle.build(docs, FIELDS, "lang", "doc_id", {"doc_id": F.col("doc_id"), "forged": forged}, fan, depth)
    got = [(r.carry.doc_id, r.leaf, r.subroot, r.root, "".join(r.siblings), r.folded_root) for r in merkle.prove(manifest, "forged").collect()]
    want = plain_manifest(rows, fan)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(x[3] != x[5] for x in got) and any(x[3] == x[5] for x in got)


def test_merkle_of_few_rows(spark):
    none = spark.createDataFrame([], DOCS)
    empty = merkle.build(none, FIELDS, "lang", "doc_id")
    assert empty.root is None and merkle.prove(empty).count() == 0
    one = documents(4)[:1]
    r = merkle.prove(merkle.build(spark.createDataFrame(one, DOCS), FIELDS, "lang", "doc_id")).head()
    assert r.root == r.subroot == r.leaf == r.folded_root == leaf(one[0]) and r.siblings == []
    with pytest.raises(ValueError):
        merkle.build(none, FIELDS, "lang", "doc_id", fan=1)


def test_ranges_hold_one_frequent_key(spark):
    df = spark.range(5000).select(F.lit("k").alias("key"), "id", (F.col("id") % 7).alias("v"))
    got = ranges.ordered(df.repartition(6, "v"), ["key", "id"], "test", "v").collect()
    assert sorted((r.id, r["at"], r.before) for r in got) == [(i, i, sum(j % 7 for j in range(i))) for i in range(5000)]


def test_mixing_against_plain(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted(((r.doc_id, r["size"], r.source_size, r.target, r.taken, r.first_position) for r in mixing.taken(docs).collect()), key=str)
    assert got == sorted(((r.doc_id, r["size"], r.source_size, r.target, r.taken, r.first_position) for r in mixing.taken(docs.repartition(7)).collect()), key=str)  # reruns agree
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    said = con.sql(ORACLES["op12_source_mixing"])
    want = sorted((tuple(dict(zip(said.columns, r))[c] for c in ("doc_id", "size", "source_size", "target", "taken", "first_position")) for r in said.fetchall()), key=str)
    assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want])
    # Targets by filling up one source after the other; what is taken meets them to the word.
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    open_, left, target = set(sizes), 1.5 * sum(sizes.values()), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in full} if full else {s: level * weight[s] for s in open_}
        left -= sum(2 * sizes[s] for s in full)
        open_ = open_ - full if full else set()
    planned = mixing.plan(docs).collect()
    by = defaultdict(int)
    for r in planned:
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r["size"]
        by[r.source] += r.taken
    assert all(abs(by[s] - target[s]) <= 0.5 for s in sizes)


def test_curriculum_follows_the_schedules(spark):
    rows = [(i, "w " * (1 + i % 13), "en", s, 0, 0, "", 0, "") for i in range(3000) for s in "abc"]
    schedules = [[(0, 4.0), (1, 0.0)], [(0, 0.0), (0.5, 0.0), (1, 4.0)], [(0, 1.0), (0.25, 3.0), (1, 3.0)]]
    order = sorted(mixing.curriculum(mixing.plan(spark.createDataFrame(rows, DOCS), schedules, share=1.0, cap=2)).collect(), key=lambda r: r.position)
    at = 0
    for r in order:  # gapless, by progress
        assert r.position == at
        at += r.words
    assert [r.progress for r in order] == sorted(r.progress for r in order)
    for s, name in zip(schedules, "abc"):
        own = [r for r in order if r.source == name]
        total = sum(r.words for r in own)
        for t in (0.1, 0.3, 0.5, 0.7, 0.9):
            reached = sum(min(t, v) * 0 + (w + (w + (x - w) * (min(t, v) - u) / (v - u))) / 2 * (min(t, v) - u) for (u, w), (v, x) in zip(s, s[1:]) if t > u)
            assert sum(r.words for r in own if r.progress <= t) / total == pytest.approx(reached / mixing.integral(s), abs=0.01)
    with pytest.raises(ValueError):
        mixing.segments([(0, 1.0), (0.5, 1.0)])
    with pytest.raises(ValueError):
        mixing.plan(spark.createDataFrame(rows[:3], DOCS), share=3.0, cap=2)


def test_mixing_of_no_words(spark):
    assert mixing.taken(spark.createDataFrame([], DOCS)).count() == 0
    got = mixing.taken(spark.createDataFrame([(1, None, "en", "a", 0, 0, "", 0, ""), (2, " \t", "en", None, 0, 0, "", 0, "")], DOCS)).collect()
    assert [(r["size"], r.target, r.taken, r.first_position) for r in got] == [(0, 0.0, 0, None)] * 2


def cheapest(codes):
    """(cost, ASCII-least letters) by a search over single edits."""
    heap, seen = [(0, "", 0, 0)], set()
    while True:
        cost, letters, i, q = heapq.heappop(heap)
        if i == len(codes) and q in (0, 3):
            return cost, letters
        if (i, q) in seen:
            continue
        seen.add((i, q))
        asked = 3 if q == 2 else 2
        heapq.heappush(heap, (cost + 2, letters + "I", i, asked))
        if i < len(codes):
            fault, role = codes[i]
            heapq.heappush(heap, (cost + 3, letters + "D", i + 1, q))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                heapq.heappush(heap, (cost + 2 + more, letters + "R", i + 1, asked))
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((q, role))
                if to:
                    heapq.heappush(heap, (cost + more, letters + "K", i + 1, to))


def plain_structure(rows, already=False):
    """The contract's rows: {conv_id: the other columns}."""
    convs = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            convs[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        faults = []
        for k, (_, role, text) in enumerate(turns):
            body = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in [x[1:] for x in turns[:k]] else "" if body[-1] in ".!?" else "truncated")
        cost, letters = cheapest([(f, x[1][:1]) for f, x in zip(faults, turns)])
        lines, k, state = [], 0, 0
        for c in letters:
            role, text = (turns[k][1:] if c != "I" else (None, ""))
            k += c != "I"
            if c != "D":
                state = {"s": 1, "u": 2, "a": 3}[role[0]] if c == "K" else 3 if state == 2 else 2
                lines.append(f"{role if c == 'K' else ('', '', 'user', 'assistant')[state]}:{text}")
        ids = [x[0] for x in turns if x[0] is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(turns)]
        out[conv] = (max(ids) - min(ids) + 1 - len(set(ids)) if ids else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, sha("\n".join(lines)))
    return out


def conversations():
    rng, rows = random.Random(9), []
    texts = ["Yes.", "No!", "Why?", "It goes on", "", " \t\n", None, "Yes. ", "é…", "A.\x0b", "ok"]
    for conv in range(250):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), rng.choice(["system", "user", "assistant", "user", "assistant", None, "tool", ""]), rng.choice(texts)))
    rows += [(None, 0, "user", "Hm."), (None, 1, "assistant", "Hm."), (900, 5, "assistant", "So."), (900, 5, "assistant", "So.")]
    rows += [(7_000, t, "user" if t % 2 else "assistant", f"{t % 50}.") for t in range(600)]  # one conversation with a third of all rows
    return rows


def test_structure_against_plain(spark, tmp_path):
    rows = conversations()
    turns = spark.createDataFrame([(*r, 1, "at", 2) for r in rows], "conv_id long, turn long, role string, text string, fault int, at string, piece int").repartition(5)
    want = plain_structure(rows)
    for piece in (7, structure.PIECE):
        after = structure.damaged(turns)
        got = structure.digests(after, structure.repair(after, piece), turns)
        assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == want
    assert max(len(x[6]) for x in want.values()) > 400 and len({c for x in want.values() for c in x[6]}) == 4
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet' where conv_id is null or conv_id < 7000")
    said = con.sql(ORACLES["op13_structure_repair"])
    assert {r[0]: r[1:] for r in said.select(*got.columns).fetchall()} == {k: v for k, v in want.items() if k != 7_000}


def test_structure_layers_in_pieces():
    rng = random.Random(4)
    names = ["", "blank", "duplicate", "truncated"]
    for _ in range(1500):
        codes = "".join(rng.choice(rng.choice(["0123", "012", "0129", "0123456789abcdef", "01289acde", "0cd", "0"])) for _ in range(rng.randint(1, 14)))
        want = cheapest([(names[int(c, 16) // 4], "sua-"[int(c, 16) % 4]) for c in codes])
        for cut in (1, 3, 100):
            pieces = [codes[i : i + cut] for i in range(0, len(codes), cut)]
            after, afters = list(structure.END), []
            for p in reversed(pieces):
                afters.insert(0, tuple(after))
                m = structure.between(p)
                after = [min((m[4 * a + b] + after[b] for b in range(4) if min(m[4 * a + b], after[b]) >= 0), default=-1) for a in range(4)]
            state, letters = 0, ""
            for k, p in enumerate(pieces):
                more, _, state = structure.traced(p, afters[k], k == len(pieces) - 1)[state]
                letters += more
            assert (after[0], letters) == want


def test_structure_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert structure.digests(none, structure.repair(none), none).count() == 0
    # Without damage: a lone system turn is cheapest deleted, and then nothing is left.
    lone = spark.createDataFrame([(1, 3, "system", "Be kind.")], "conv_id long, turn long, role string, text string")
    edits, counts = structure.repair(lone)
    assert [(r.edit, r.turn, r.role, r.text) for r in edits.collect()] == [("D", 3, "system", "Be kind.")]
    assert [(r.conv_id, r.cost, r.illegal) for r in counts.collect()] == [(1, 3, 0)]


def test_new_queries_are_registered():
    assert {"op11_merkle_manifest", "op12_source_mixing", "op13_structure_repair"} <= QUERIES.keys() & ORACLES.keys()
    assert queries.ORACLES is ORACLES
