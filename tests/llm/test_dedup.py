import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemill.llm import linededup
from tidemill.llm.components import components
from tidemill.llm.exactdedup import directory, exact_duplicates, route
from tidemill.llm.linededup import extend, line_dedup, winnow
from tidemill.llm.neardup import near_duplicates, without_near_duplicates
from tidemill.llm.queries import op7_line_dedup
from tidemill.llm.store import Scratch

DOCS = "doc_id long, text string, bands string, score int, runs int"
WORDS = [f"w{i}" for i in range(400)]
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_near(rows, n, percent):
    """Set size, component's id and kept, row by row."""
    sets = []
    for _, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        least[root(x)] = min((j for j in (least.get(root(x)), i) if j is not None), default=None)
    return sorted(((i, len(sets[x]), least[root(x)], i == least[root(x)]) for x, (i, _) in enumerate(rows)), key=repr)


def near(df, *args):
    return sorted(map(tuple, near_duplicates(df, *args).collect()), key=repr)


def edited(rng, words, share):
    return [rng.choice(WORDS) if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "é É")]
    base = [rng.choice(WORDS) for _ in range(120)]
    hub = [rng.choice(WORDS) for _ in range(150)]
    for i in range(10, 60):
        rows.append((i, " ".join(edited(rng, base, rng.choice([0, 0.01, 0.02, 0.05])))))
    for i in range(60, 100):  # copies of one original that are often not near each other
        rows.append((i, " ".join(edited(rng, hub, 0.025))))
    rows.append((100, " ".join(hub)))
    rows += [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60)))) for i in range(200, 230)]
    rows.append((300, " ".join(rng.choice(WORDS) for _ in range(30000))))
    rows.append((301, rows[-1][1] + " more"))
    return rows


@pytest.mark.parametrize(("n", "percent"), [(4, 80), (5, 80), (3, 90)])
def test_near_duplicates_against_brute_force(frame, corpus, n, percent):
    df = frame([(i, t, "x", 1, 2) for i, t in corpus], DOCS).repartition(5)
    assert near(df, n, percent) == brute_near(corpus, n, percent)


def test_near_duplicates_of_blocks(frame, corpus, monkeypatch):
    from tidemill.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK", 300)  # mixed buckets are cut into many blocks
    df = frame([(i, t, "x", 1, 2) for i, t in corpus], DOCS)
    assert near(df, 4, 80) == brute_near(corpus, 4, 80)


def repeated_ids(seed=11):
    """Rows that repeat ids with other texts, rows without an id, and near copies among all of them."""
    rng = random.Random(seed)
    bases = [[rng.choice(WORDS) for _ in range(80)] for _ in range(8)]
    rows = [(5, " ".join(bases[0])), (5, " ".join(bases[1])), (9, " ".join([*bases[0][1:], "x"])), (9, " ".join([*bases[1][1:], "y"])), (None, " ".join(bases[2])), (None, " ".join(bases[2]) + " z")]
    rows += [(rng.choice([None, *range(1, 25)]), " ".join(edited(rng, rng.choice(bases), 0.01))) for _ in range(60)]
    rows += [(3, None), (3, ""), (None, None), (None, ""), (0, " ".join(bases[3])), (None, " ".join(bases[3])), (7, " ".join(bases[4])), (7, " ".join(bases[4]))]
    return rows


def test_near_duplicates_of_repeated_and_missing_ids(frame):
    rows = repeated_ids()
    df = frame([(i, t, "x", 1, 2) for i, t in rows], DOCS).repartition(5)
    assert near(df, 4, 80) == brute_near(rows, 4, 80)


def test_one_row_of_each_component_stays(frame):
    rows = repeated_ids()
    got = [(r.doc_id, r.text) for r in without_near_duplicates(frame([(i, t, "x", 1, 2) for i, t in rows], DOCS), 4, 80).collect()]
    want = [r for r in brute_near(rows, 4, 80) if r[1]]  # with words
    assert len([1 for _, t in got if t]) == len(rows_of_components(rows, 4, 80))
    assert {i for i, t in got if t and i is not None} <= {r[2] for r in want}
    assert {r[2] for r in want} - {None} == {i for i, t in got if t and i is not None}
    assert sorted([x for x in got if not x[1]], key=repr) == [(3, ""), (3, None), (None, ""), (None, None)]


def rows_of_components(rows, n, percent):
    """One number for each component with words, whatever its ids."""
    numbered = [(k, t) for k, (_, t) in enumerate(rows)]
    return {r[2] for r in brute_near(numbered, n, percent) if r[1]}


def test_near_duplicates_of_odd_tables(frame):
    assert near_duplicates(frame([], DOCS)).collect() == []
    assert without_near_duplicates(frame([], DOCS)).collect() == []
    one = near_duplicates(frame([(1, "a b c d e f", "", 0, 0), (1, "a b c d e f", "", 0, 0), (None, "a b c d e f", "", 0, 0), (9, None, None, None, None)], DOCS)).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in one) == [(0, 1, False), (1, 1, True), (1, 1, True), (9, 9, True)]


def test_components(frame, spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 180)] + [(500, 500), (7, 3)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.id: r.comp for r in components(frame(edges, "u long, v long"), Scratch(spark, "t"), "c").collect()}
    assert got == {x: root(x) for x in parent}
    assert components(frame([], "u long, v long"), Scratch(spark, "t"), "c").collect() == []


ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (6, "A"), (7, "a "), (8, "x" * 300000), (9, "x" * 300000), (9, "x" * 300000), (None, "b"), (None, "c")]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(frame, weak):
    from pyspark.sql import functions as F

    args = {"hash_of": lambda c: F.xxhash64(F.length(c) % 3), "capacity": 1, "hot": 3} if weak else {}
    df = frame([(i, t, 5, "x") for i, t in ROWS], "doc_id long, text string, hash int, keep_id string")
    got = sorted(map(tuple, exact_duplicates(df, **args).collect()), key=repr)
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    want = []
    for i, t in ROWS:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        want.append((i, keep, len(own), i is not None and i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert exact_duplicates(df.limit(0), **args).collect() == []


def test_directory_doubles_until_buckets_fit(spark):
    from pyspark.sql import functions as F

    # Half of the hashes share their first 20 bits: one bucket goes on splitting, beyond the bits of the directory's slots.
    hashes = spark.range(2000).select(F.expr("if(id < 1000, xxhash64(id), shiftrightunsigned(xxhash64(id), 20))").alias("hash"))
    depths = directory(hashes, 60, Scratch(spark, "t"))
    counts = Counter((r.depth, r.bucket) for r in route(hashes, depths).collect())
    assert sum(counts.values()) == 2000 and max(counts.values()) <= 60
    assert max(d for d, _ in counts) > 20 > min(d for d, _ in counts)
    for r in route(hashes, depths).collect():
        assert (r.hash % 2**64) >> (64 - r.depth) == r.bucket
    assert directory(hashes.limit(0), 60, Scratch(spark, "t")).collect() == []


def test_groups_are_made_in_the_buckets_that_the_directory_names(frame, monkeypatch):
    from pyspark.sql import functions as F

    from tidemill.llm import exactdedup

    df = frame([(i, f"t{i % 5}") for i in range(20)], "doc_id long, text string")
    assert {r.group_size for r in exact_duplicates(df).collect()} == {4}
    real = exactdedup.route
    wrong = lambda rows, depths: real(rows, depths).withColumn("bucket", F.col("doc_id") % 2)
    monkeypatch.setattr(exactdedup, "route", wrong)
    assert {r.group_size for r in exact_duplicates(df).collect()} == {2}


def test_winnowing_guarantees_a_common_fingerprint():
    rng = np.random.default_rng(3)
    need = linededup.GRAM + linededup.WINDOW - 1
    for _ in range(300):
        run = rng.integers(0, 50, need).astype(np.uint64)
        a, b = (np.concatenate([rng.integers(0, 50, rng.integers(0, 9)).astype(np.uint64), run, rng.integers(0, 50, rng.integers(0, 9)).astype(np.uint64)]) for _ in range(2))
        assert set(winnow(a)[1].tolist()) & set(winnow(b)[1].tolist())
    assert len(winnow(np.zeros(need - 1, np.uint64))[0]) == 0
    assert extend(np.array([1, 2, 3, 4, 9]), np.array([7, 2, 3, 4, 8]), 2, 2) == (1, 3)


def passage(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_later_copies_of_passages_go(frame):
    rng = random.Random(8)
    long, lines, short = passage(rng, 60), "\n".join(passage(rng, 11) for _ in range(6)), passage(rng, 20)
    own = [passage(rng, 40) for _ in range(12)]
    rows = [
        (1, f"{own[0]}\n{long}\n{own[1]}"),
        (2, f"{own[2]}\n  {long.upper()}\n{own[3]}"),
        (3, f"{long}"),
        (4, f"{own[4]}\n{lines}\n{own[5]}\n{lines}"),
        (5, f"{lines}\n{own[6]}\n"),
        (6, f"{short}\n{own[7]}"), (7, f"{short}\n{own[8]}"), (8, None), (9, ""), (10, "\n\n"), (11, " ".join(["same"] * 3000)), (12, passage(rng, 50000)),
    ]
    df = frame([(i, t, "x", 1, 2) for i, t in rows], DOCS).repartition(3)
    got = {r.doc_id: r for r in line_dedup(df).collect()}
    text = {i: r.text for i, r in got.items()}
    was = dict(rows)
    for i in (1, 6, 8, 9, 10, 12):
        assert text[i] == was[i] and got[i].runs is None and got[i].removed_words == 0, i
    assert text[2] == f"{own[2]}\n{own[3]}" and got[2].removed_words == 60
    assert text[7] == own[8] and text[3] == "" and text[4] == f"{own[4]}\n{lines}\n{own[5]}" and text[5] == f"{own[6]}\n"
    assert text[11].count("same") < 60 and got[2].bands == "x" and got[2].score == 1
    assert line_dedup(df.limit(0)).collect() == []


def brute_repeats(rows, n=50, least=5):
    """Word numbers inside a later occurrence of any n words or of whole lines with ``least`` words, by row (ids None come last)."""
    seen, seen_lines, out = set(), set(), defaultdict(set)
    for x, (_, text) in enumerate(rows):
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
        for k in range(len(w) - n + 1):
            run = tuple(w[k : k + n])
            if run in seen:
                out[x] |= set(range(k, k + n))
            seen.add(run)
        ends = np.cumsum([len(re.findall("[^\x20\x09-\x0d]+", line)) for line in (text or "").split("\n")]).tolist()
        ends = [0, *sorted(set(ends) - {0})]
        for i, a in enumerate(ends):
            for b in ends[i + 1 :]:
                if b - a >= least:
                    run = hash(tuple(w[a:b]))
                    if run in seen_lines:
                        out[x] |= set(range(a, b))
                    seen_lines.add(run)
    return out


def removed(r):
    return {k for x in r.runs or [] for k in range(x.first, x.last + 1)}


def test_line_dedup_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = brute_repeats(rows)
    got = {r.doc_id: r for r in line_dedup(docs).collect()}
    assert len(got) == docs.count() and sum(map(len, want.values())) > 0
    for x, (i, _) in enumerate(rows):
        assert removed(got[i]) == want.get(x, set()) and got[i].removed_words == len(want.get(x, set())), i


def test_short_lines_and_blocks_of_lines(frame):
    rng = random.Random(6)
    line, block = passage(rng, 9), "\n".join(passage(rng, 15) for _ in range(3))
    stubs = ["one two", "three", "four five six", "seven"]  # too short alone
    rows = [(i, "\n".join([f"a{i} b{i}", passage(rng, 12), line if i % 2 else block, passage(rng, 12), *stubs[: 2 + i % 3], f"z{i}"])) for i in range(50)]
    rows += [(50, f"\n\n{line.upper()}\r\n \n"), (51, f"{line} more"), (52, "three\nfour five six\nseven\n" * 2)]
    want = brute_repeats(rows)
    got = {r.doc_id: r for r in line_dedup(frame(rows, "doc_id long, text string").repartition(4)).collect()}
    for x, (i, _) in enumerate(rows):
        assert removed(got[i]) == want.get(x, set()), i
    assert sum(line in r.text for r in got.values()) == 2 and sum(block in r.text for r in got.values()) == 1  # 51 has no such line
    assert got[50].text == "" and got[51].removed_words == 0


@pytest.mark.parametrize("blocks", [1 << 18, 0])
def test_line_dedup_of_repeated_and_missing_ids(frame, monkeypatch, blocks):
    monkeypatch.setattr(linededup, "FILTER_BLOCKS", blocks)  # with and without the filter before the joins
    rng = random.Random(28)
    hot, line = passage(rng, 60), passage(rng, 9)
    rows = []
    for i in range(28):  # each id twice: a text of its own, and a copy
        rows += [(i, passage(rng, 70)), (i, f"{passage(rng, 5)}\n{line}\n{hot} {i}")]
    rows += [(None, hot), (None, passage(rng, 60)), (None, line)]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    got = line_dedup(frame([(i, t, 7) for i, t in rows], "doc_id long, text string, removed_words int").repartition(5)).collect()
    assert len(got) == len(rows)
    text = Counter((r.doc_id, r.text) for r in got)
    for i, t in rows[:56:2]:
        assert text[i, t] == 1  # what is there once stays whole
    want = brute_repeats(order)
    lost = Counter(order[x][0] for x, gone in want.items() for _ in gone)
    assert Counter({i: n for i, n in lost.items() if n}) == Counter(r.doc_id for r in got for _ in removed(r))
    assert text[None, ""] == 2 and text[None, rows[57][1]] == 1


def test_passages_are_found_wherever_they_begin_in_a_line(frame):
    rng = random.Random(21)
    planted = [passage(rng, rng.randint(50, 90)) for _ in range(10)]
    rows, starts = [], {}
    for i in range(200):
        before, after = (f"a{i} " + passage(rng, rng.randint(0, 30)), f"z{i} " + passage(rng, rng.randint(0, 30)))
        starts[i] = len(before.split())
        again = planted[i % 10].split(" ") if i >= 10 else []
        again = "".join(w + rng.choice("  \n") for w in again).strip()  # copies are wrapped anew
        rows.append((i, f"{before} {planted[i]} {after}" if i < 10 else f"{before} {again} {after}"))
    want = brute_repeats(rows)
    got = {r.doc_id: r for r in line_dedup(frame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert all(got[i].removed_words == 0 and got[i].text == t for i, t in rows[:10])
    for i, t in rows[10:]:
        out, at = removed(got[i]), starts[i]
        assert set(range(at, at + len(planted[i % 10].split()))) <= out and out == want[i], i
        assert got[i].text.split() == [x for k, x in enumerate(t.split()) if k not in out], i


def test_edited_early_copies_hide_no_later_ones(frame):
    rng = random.Random(34)
    rows = []
    for n in (50, 52, 60, 75):
        hot = passage(rng, n).split()
        for k in range(30):
            own = list(hot)
            if k < 6:  # a new word in the middle third
                own[rng.randrange(n // 3, 2 * n // 3)] = f"new{n}x{k}"
            rows.append((len(rows), f"{passage(rng, rng.randint(5, 40))} {' '.join(own)} {passage(rng, rng.randint(5, 40))}"))
    want = brute_repeats(rows)
    assert all(len(want[i]) >= 50 for i, _ in rows if 7 <= i % 30)
    got = {r.doc_id: r for r in line_dedup(frame(rows, "doc_id long, text string").repartition(5)).collect()}
    for i, t in rows:
        out = removed(got[i])
        assert out == want.get(i, set()) and got[i].removed_words == len(out), i


def test_cut_keeps_lines_apart():
    text = b"a b\nc d e\nf g\nh"
    assert linededup.cut(text, [{"first": 2, "last": 4}]) == (b"a b\nf g\nh", 3)
    assert linededup.cut(text, [{"first": 1, "last": 3}]) == (b"a e\nf g\nh", 3)
    assert linededup.cut(text, [{"first": 1, "last": 4}, {"first": 3, "last": 4}]) == (b"a\nf g\nh", 4)
    assert linededup.cut(text, [{"first": 2, "last": 5}]) == (b"a b\ng\nh", 4)
    assert linededup.cut(text, [{"first": 6, "last": 9}]) == (b"a b\nc d e\nf", 2)
    assert linededup.cut(text, [{"first": 0, "last": 99}]) == (b"", 8)
    assert linededup.cut("é x ü".encode(), [{"first": 1, "last": 1}]) == ("é ü".encode(), 1)


def test_repeated_rows_of_a_document(frame):
    rng = random.Random(2)
    t = passage(rng, 80)
    got = line_dedup(frame([(1, t), (1, t), (2, t), (None, t)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text == "") for r in got) == [(0, True), (1, False), (1, False), (2, True)]


def test_line_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want = brute_repeats(rows)
    got = {r.doc_id: r for r in op7_line_dedup(spark, sf).collect()}
    assert got.keys() == {i for i, _ in rows}
    for x, (i, text) in enumerate(rows):
        assert removed(got[i]) == want.get(x, set())
        if x not in want:
            assert got[i].text_sha256 == hashlib.sha256(text.encode()).hexdigest()
