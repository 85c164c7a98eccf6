"""SimHash, exact digests, line templates and components against brute force."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import fingerprints, graph, line_dedup, simhash
from tests.llm.conftest import ODD


def groups(n, edges):
    top = list(range(n))

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_hashes_are_sparks(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("drei Wörter hier"))).first()[0] == simhash.signed(xxhash.xxh64_intdigest("drei Wörter hier".encode(), 42))


def test_near_duplicates_are_all_found(spark, documents, texts):
    rows = {r.doc_id: r for r in simhash.near_duplicates(documents).collect()}
    ids = list(texts)
    fps = np.array([plain_fingerprint(texts[i]) for i in ids], np.uint64)
    assert [rows[i].fingerprint for i in ids] == [f"{int(x):016x}" for x in fps]
    edges = [(a, a + 1 + int(b)) for a in range(len(ids)) for b in np.flatnonzero(np.bitwise_count(fps[a + 1 :] ^ fps[a]) <= 2)]
    assert [rows[i].component_id for i in ids] == [ids[g] for g in groups(len(ids), edges)]


@pytest.mark.parametrize("crowd", [simhash.CROWD, 1])
@pytest.mark.parametrize("most", [0, 1, 2])
def test_links_join_just_what_is_near(spark, crowd, most):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 8)
    fps = sorted({int(b) ^ (1 << int(i)) ^ (1 << int(j)) ^ (1 << int(k)) for b in base for i, j, k in rng.integers(0, 63, (25, 3))} | {0, -1, -2, 1})
    links = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), most, crowd=crowd)
    at = {x: k for k, x in enumerate(fps)}
    u = np.array(fps, np.int64).view(np.uint64)
    near = [(a, b) for a in range(len(fps)) for b in range(a) if np.bitwise_count(u[a] ^ u[b]) <= most]
    found = [(at[r.u], at[r.v]) for r in links.collect()]
    assert set(map(frozenset, found)) <= set(map(frozenset, near)) if near else not found
    assert groups(len(fps), found) == groups(len(fps), near)


def test_thresholds_sum_up_and_cost_least():
    rng = np.random.default_rng(1)
    costs = [rng.uniform(0, 9, (20, 3)).cumsum(1) for _ in range(3)]
    got = simhash.allocate(costs, 2)
    assert ((got + 1).sum(1) == 3).all()
    price = lambda row, t: sum(costs[i][row, x] for i, x in enumerate(t) if x >= 0)
    every = [(a, b, c) for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3) if a + b + c == 0]
    for row in range(20):
        assert price(row, got[row]) == pytest.approx(min(price(row, t) for t in every))


def test_odd_rows_have_defined_groups(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[3].fingerprint == by[4].fingerprint == by[5].fingerprint == "0" * 16
    assert by[4].component_id == 3 and by[2].component_id == 1
    assert by[None].component_id is None
    assert simhash.near_duplicates(empty).count() == 0
    wide = {r.doc_id: r.component_id for r in simhash.text_near_duplicates(odd).collect()}
    assert wide[2] == 1 and wide[5] == 3 and wide[7] == 7 and wide[None] is None
    assert simhash.text_near_duplicates(empty).count() == 0


def test_texts_alike_in_five_words_are_grouped(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    rows, truth = [], []
    for g in range(30):
        base = rng.choice(words, 300).tolist()
        for c in range(4):
            text = list(base)
            for at in rng.choice(300, c, replace=False):  # up to three words of 300: similarity above 0.9
                text[at] = f"x{rng.integers(1e9)}"
            truth.append(4 * g)
            rows.append((len(rows), " ".join(text)))
    got = [r.component_id for r in simhash.text_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == truth


def test_a_crowd_of_near_copies_is_one_group(spark):
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in rng.integers(0, 5000, 200)]
    rows = []
    for i in range(400):
        text = list(base)
        for at in rng.choice(200, 2, replace=False):
            text[at] = f"x{rng.integers(1e9)}"
        rows.append((i, " ".join(text)))
    got = simhash.text_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("component_id = 0").count() >= 396


def five_words(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def plain_groups(texts):
    sets = [five_words(t) for t in texts]
    return groups(len(sets), [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])


def grouped(spark, texts, parts=3):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    return [r.component_id for r in simhash.text_near_duplicates(rows).orderBy("doc_id").collect()]


def test_block_edits_are_grouped_as_by_brute_force(spark):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for k in range(160):
        n = int(rng.integers(8, 600))
        base, block = rng.choice(words, n).tolist(), rng.choice(words, n).tolist()
        share = rng.uniform(0.02, 0.3)
        edited = base + block[: round(share * n)] if k % 2 else base[: round((1 - share / 2) * n)] + block[: round(share / 2 * n)]
        texts += [" ".join(base), " ".join(edited)]
    want = plain_groups(texts)
    assert 60 < sum(want[i] != i for i in range(len(want))) < 140
    assert grouped(spark, texts) == want


def test_signatures_of_alike_sets_meet():
    rng = np.random.default_rng(12)
    signatures = simhash.Signatures(0.8)
    for n in [*range(4, 60), 100, 333, 1000, 5000]:
        for _ in range(20):
            union = np.unique(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False))
            lost = rng.permutation(len(union))[: len(union) // 5]
            cut = int(rng.integers(0, len(lost) + 1))
            a, b = np.delete(union, lost[:cut]), np.delete(union, lost[cut:])
            assert signatures.alike(a, b)
            assert np.array_equal(a, b) or len(np.intersect1d(signatures.of(a), signatures.of(b)))


@pytest.mark.parametrize("parts", [1, 7])
def test_crowds_are_grouped_as_by_brute_force(spark, parts):
    rng = np.random.default_rng(13)
    words = [f"w{i}" for i in range(5000)]
    base = rng.choice(words, 200).tolist()
    texts = [" ".join(base)]
    for _ in range(300):  # each alike to the base, few to each other
        text = list(base)
        at = int(rng.integers(0, 185))
        text[at : at + 14] = rng.choice(words, 14).tolist()
        texts.append(" ".join(text))
    passage = rng.choice(words, 150).tolist()
    texts += [" ".join(passage + rng.choice(words, int(rng.integers(20, 60))).tolist()) for _ in range(150)]  # unlike, about one passage
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = grouped(spark, texts, parts)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == plain_groups(texts)


def test_blocks_of_a_crowd_meet(spark):
    rng = np.random.default_rng(14)
    base = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[:350], rng.integers(0, 1 << 62, 10).astype(np.uint64)])) for _ in range(30)]
    frame = spark.createDataFrame([(k, len(s), simhash.signed(simhash.majority(s)), simhash.parity(s), s.tobytes()) for k, s in enumerate(sets)], "key long, n int, fp long, bits binary, members binary")
    members = spark.createDataFrame([(1, k) for k in range(30)], "sig long, key long")
    roots = spark.createDataFrame([], "node long, root long")
    got = {(r.u, r.v) for r in simhash.open_pairs(members, roots, frame, 0.8, False, block=4).collect()}
    assert got == {(a, b) for a in range(30) for b in range(a)}


@pytest.mark.parametrize("rows, at_once", [(4, 3), (4096, 100_000)])
def test_cells_give_each_pair_once(monkeypatch, rows, at_once):
    monkeypatch.setattr(simhash, "CELL_ROWS", rows)
    monkeypatch.setattr(simhash, "CELL_PAIRS", at_once)
    names = [(1, 0, 0, 0)] * 3 + [(1, 0, 1, 0)] * 2 + [(1, 0, 1, 1)] * 3 + [(2, 0, 0, 0)] + [(3, 0, 0, 0)] * 5
    table = pa.table([pa.array(c) for c in zip(*names, strict=True)] + [pa.array(range(len(names)))], ["sig", "i", "j", "own", "key"])
    got = []
    for part, cells in simhash._cells(table.to_batches(max_chunksize=3)):
        i, j, own, key = (part.column(c).to_numpy() for c in ("i", "j", "own", "key"))
        for left, right in simhash._pairs_of(cells, i, j, own):
            got += zip(key[left].tolist(), key[right].tolist(), strict=True)
    pairs = lambda a, b: [(x, y) for x in range(a, b) for y in range(x + 1, b)]
    assert sorted(got) == sorted(pairs(0, 3) + [(x, y) for x in (3, 4) for y in (5, 6, 7)] + pairs(9, 14))


def test_pairs_below_the_similarity_stay_apart(spark):
    texts = []
    for k in range(80):
        base = [f"{k}w{i}" for i in range(304)]  # 300 shingles
        edited = base + [f"{k}x{i}" for i in range(75 + k % 2)]  # 300 of 375 or 376 shingles: 0.8 or just below
        texts += [" ".join(base), " ".join(edited)]
        if k % 4 == 0:  # a passage over and over: sets count, not repeats
            texts += [" ".join(base + base[:40] * 9)]
    want = plain_groups(texts)
    assert grouped(spark, texts) == want


def test_a_table_is_grouped_as_by_all_pairs(spark):
    """Recall and precision are whole: the groups of 1,000 documents are those of every pair compared."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    texts = [r.text for r in rows]
    assert grouped(spark, texts) == plain_groups(texts)


def test_wide_bitmaps_bound_the_difference_and_tell_large_sets_apart():
    rng = np.random.default_rng(15)
    for n, m in [(30, 30), (1000, 1100), (1000, 1250), (4000, 4100), (16_000, 17_000), (60_000, 70_000)]:
        for share in (0.0, 0.5, 0.9, 1.0):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[: int(share * n)], rng.integers(0, 1 << 63, m - int(share * n)).astype(np.uint64)]))
            differ = len(a) + len(b) - 2 * len(np.intersect1d(a, b))
            apart = simhash.bits_apart(simhash.wide_parity(a), simhash.wide_parity(b))
            assert apart <= differ and apart == simhash.bits_apart(simhash.wide_parity(b), simhash.wide_parity(a))
            if share <= 0.5 and n >= 1000:
                assert apart > simhash.Signatures(0.8).most(len(a) + len(b))


def test_sets_are_not_stored(spark, tmp_path):
    """What is checkpointed takes far less than the sets' 8 bytes a shingle; copies, in the same letters or not, are grouped all the same."""
    rng = np.random.default_rng(16)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 1 << 30, 3000)) for _ in range(60)]
    texts += [texts[3], texts[3].upper(), texts[7].replace(" ", "  "), texts[9][: 9 * len(texts[9]) // 10]] + ["", " "]
    want = [*range(60), 3, 3, 7, 9, 64, 64]
    before = spark.sparkContext._jsc.sc().getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        got = grouped(spark, texts)
    finally:
        if before.isDefined():
            spark.sparkContext._jsc.sc().setCheckpointDir(before.get().rsplit("/", 1)[0])
    assert got == want
    assert 0 < sum(f.stat().st_size for f in tmp_path.rglob("part-*")) < 60 * 3000 * 8 / 2


def test_near_fingerprints_of_sets_are_candidates(spark):
    """Sets of one fingerprint, and of fingerprints within two bits, are paired up; a wrong pair does no harm, as links are verified."""
    sets = spark.createDataFrame([(1, 0), (2, 0), (3, 3), (4, 3 << 40), (5, -1)], "key long, fp long")
    got = {(r.u, r.v) for r in simhash.fingerprint_pairs(sets).collect()}
    assert got == {(2, 1), (3, 1), (4, 1)}


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(500, 500)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 160)} == {100} and 500 not in got
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def tasks_of(spark, name, run):
    """Tasks of the jobs that ``run`` starts, those skipped left out, and what it returns."""
    context = spark.sparkContext
    context.setJobGroup(name, name)
    try:
        out = run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds}
    return sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i), out


@pytest.fixture
def many_partitions(spark):
    """Shuffles in 40 partitions whatever their size."""
    put = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in put}
    for k, v in put.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_few_edges_take_few_tasks_in_many_partitions(spark, many_partitions):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")
    tasks, rows = tasks_of(spark, "few edges", lambda: graph.components(edges).collect())
    assert {(r.node, r.root) for r in rows} == {(i, 0) for i in range(301)}
    assert tasks < 5 * 40


def test_near_duplicates_of_a_small_table_take_few_tasks_in_many_partitions(spark, many_partitions):
    rng = np.random.default_rng(8)
    base = [[f"w{x}" for x in rng.integers(0, 900, 80)] for _ in range(3)]
    texts = [" ".join([*b[:k], f"x{k}", *b[k + 1 :]]) for b in base for k in range(0, 80, 10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    tasks, rows = tasks_of(spark, "small table", lambda: simhash.text_near_duplicates(docs).collect())
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    alike = [(a, b) for a in range(24) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert [r.component_id for r in sorted(rows)] == groups(24, alike)
    assert tasks < 4_500


@pytest.mark.parametrize("seed", range(3))
def test_edges_are_joined_up_alike_on_the_driver_and_in_rounds(spark, seed):
    rng = np.random.default_rng(seed)
    drawn = rng.integers(0, 150, (110, 2)).tolist()
    edges = spark.createDataFrame([(a - 75, b - 75) for a, b in drawn] + [(None, 3), (4, None), (9, 9)], "u long, v long")
    expected = {(a - 75, r - 75) for a, r in enumerate(groups(150, drawn)) if any(a in e and e[0] != e[1] for e in drawn)}
    for most in (None, 0):
        rows = graph.components(edges, most).collect()
        assert {(r.node, r.root) for r in rows} == expected and len(rows) == len(expected)


def test_digests_fold_and_tell_apart(spark, odd, empty):
    assert fingerprints.canonical("  Straße ＡＢＣ\n") == fingerprints.canonical("STRASSE abc")
    rows = {r.doc_id: r for r in fingerprints.fingerprints(odd).collect()}
    assert rows[1].fingerprint == rows[2].fingerprint and rows[1].n_copies == 3
    assert rows[3].fingerprint == rows[4].fingerprint == rows[5].fingerprint
    assert len({rows[i].fingerprint for i in (1, 3, 6, 7, 8)}) == 5
    assert fingerprints.fingerprints(empty).count() == 0


def test_equal_digests_of_other_bytes_are_numbered(spark, monkeypatch):
    rows = spark.createDataFrame([("d", b"one"), ("d", b"two"), ("d", b"one"), ("e", b"three")], "fingerprint string, folded binary")
    got = {(r.fingerprint, bytes(r.folded)): r.number for r in fingerprints._bucket_numbers(rows).collect()}
    assert got == {("d", b"one"): 0, ("d", b"two"): 1}
    docs = spark.createDataFrame([(1, "a b"), (2, "A  b"), (3, "c")], "doc_id long, text string")
    whole = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()}
    monkeypatch.setattr(fingerprints, "AGAIN_BROADCAST", 0)
    assert {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()} == whole


@pytest.mark.parametrize("parts", [1, 4])
def test_edited_texts(spark, odd, empty, documents, texts, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    rows = {r.doc_id: r for r in fingerprints.edited_fingerprints(documents.repartition(3)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    ids = list(texts)
    assert len(rows) == len(ids)
    for i, j in zip(ids, [*ids[1:], ids[0]], strict=True):
        edited = fingerprints.edited_text(texts[i], texts[j])
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(texts[i]), hashlib.sha256(edited.encode()).hexdigest())
        same = fingerprints.canonical(texts[i]) == fingerprints.canonical(edited)
        assert rows[i].near_edited == float(same) and (rows[i].fingerprint == rows[i].edited_fingerprint) == same
        assert rows[i].near_next == float(fingerprints.canonical(texts[i]) == fingerprints.canonical(texts[j]))
    assert fingerprints.edited_fingerprints(odd).count() == len(ODD)
    assert fingerprints.edited_fingerprints(empty).count() == 0
    one = fingerprints.edited_fingerprints(odd.where("doc_id = 1")).first()
    assert one.near_next == 1.0


def test_templates_generalise_variable_fields():
    t = line_dedup.templates
    assert t(b"Licensed under version 3 of it") == t(b"Licensed under version 41 of it")
    a = b"one two three four five six seven eight nine ten eleven twelve thirteen"
    b = a.replace(b"nine", b"NINE")
    assert set(t(a)) & set(t(b)) and t(a)[0] != t(b)[0]
    assert not set(t(a)) & set(t(a.replace(b"one", b"ONE"))) and not t(b" ")
    assert not set(t(b"1 22 3 total")) & set(t(b"4 55 6 total"))
    fields = [b"Posted by %s in category %s yesterday evening" % x for x in ((b"anna", b"sports"), (b"otto", b"letters"))]
    assert set(t(fields[0])) & set(t(fields[1])) and t(fields[0])[0] & 3 == line_dedup.WHOLE
    assert t(b"Read more here")[0] & 3 == line_dedup.SHORT and all(x & 3 == line_dedup.VARIED for x in t(a)[1:])


def plain_tokens(line):
    tokens = line.split()
    fields = [t for t in tokens if any(48 <= c < 58 for c in t)]
    return tuple(b"<*>" if t in fields and 2 * len(fields) <= len(tokens) else t for t in tokens)


def alike_lines(a, b):
    """Whether two lines have a template in common, by comparing their tokens block by block; "whole" if all are equal."""
    a, b = plain_tokens(a), plain_tokens(b)
    if a == b:
        return "whole"
    if len(a) != len(b) or a[:2] != b[:2]:
        return ""
    for low, high, blocks, varying in line_dedup.VARYING:
        if low <= len(a) < high:
            m = len(a) - 2
            bounds = [2 + m * k // blocks for k in range(blocks + 1)]
            return "varied" if sum(a[x:y] != b[x:y] for x, y in zip(bounds, bounds[1:], strict=False)) <= varying else ""
    return ""


def test_templates_are_shared_by_just_the_lines_that_agree(texts):
    rng = np.random.default_rng(3)
    lines = [x.encode() for t in list(texts.values())[:60] if t for x in t.split("\n")][:300] + [b"", b" \t ", "日本語の行 x".encode()]
    for x in list(lines[:300]):  # and the same with one to three tokens changed
        tokens = x.split()
        for k in rng.integers(0, len(tokens), rng.integers(1, 4)) if tokens else []:
            tokens[k] = b"v%d" % rng.integers(3) if rng.random() < 0.3 else b"other"
        lines.append(b" ".join(tokens))
    of, names = line_dedup.Lines([b"\n".join(lines[:200]), b"", b"\n".join(lines[200:])]).templates()
    of = np.where(of > 200, of - 1, of)  # the empty text is a line too
    mine = [set() for _ in lines]
    for k, name in zip(of.tolist(), names.tolist(), strict=True):
        mine[k].add(name)
    for k, x in enumerate(lines):
        assert mine[k] == set(templates_of(x))
        for j in range(k):
            want = alike_lines(x, lines[j]) if x.split() and lines[j].split() else ""
            both = mine[k] & mine[j]
            assert bool(both) == bool(want) and any(v & 3 != line_dedup.VARIED for v in both) == (want == "whole")


def templates_of(line):
    return line_dedup.templates(line)


def test_texts_are_cut_between_lines_without_a_trace(spark, monkeypatch, lined):
    docs, _, real = lined
    want = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_recurring(docs).collect()}
    raw = [t.encode() for t in real.values()]
    whole = [(t, sorted(n)) for t, n in _templates_by_text(raw)]
    monkeypatch.setattr(line_dedup, "STEP_BYTES", 100)
    assert [(t, sorted(n)) for t, n in _templates_by_text(raw)] == whole
    one = raw[0]
    line, names, hashes, of, n = line_dedup._whole(one, None)[0]
    monkeypatch.undo()
    alone = line_dedup.Lines([one])
    assert np.array_equal(np.sort(hashes), np.sort(alone.shingles()[0])) and n == len(one.split(b"\n"))
    assert set(zip(line.tolist(), names.tolist())) == set(zip(*(x.tolist() for x in alone.templates())))
    known = np.sort(names[line == 2])
    assert line_dedup._gone(one, known).tolist() == [k == 2 for k in range(n)]
    assert want


def _templates_by_text(raw):
    out = {}
    for owner, lines in line_dedup._steps(raw):
        line, names = lines.templates()
        for t, n in zip(owner[lines.text[line]].tolist(), names.tolist(), strict=True):
            out.setdefault(t, []).append(n)
    return out.items()


def test_sketches_are_compared_as_sets():
    rng, most, common = np.random.default_rng(8), line_dedup.SKETCH, line_dedup.COMMON
    rows = []
    for _ in range(400):
        pool = rng.integers(0, 1 << 31, 96, np.uint64).astype(np.uint32)
        a, b = (np.unique(rng.choice(pool, rng.integers(0, most + 1), replace=False))[:most] for _ in range(2))
        sizes = rng.integers(0, 40, 4).astype(np.uint64)
        rows.append((sizes[:2].tobytes() + a.tobytes(), sizes[2:].tobytes() + b.tobytes(), a, b, sizes.astype(int)))
    left, right = (pa.array([b""] * 3 + [r[k] for r in rows], pa.binary()).slice(3) for k in (0, 1))
    want = []
    for _, _, a, b, (inside, rest, other, more) in rows:
        least = sorted({*a.tolist(), *b.tolist()})[:most]
        both = len([x for x in least if x in a and x in b])
        want.append(5 * min(inside, other) >= 4 * (max(inside, other) + rest + more) or most * both >= common * len(least))
    assert line_dedup.alike(left, right).tolist() == want


def test_a_large_crowd_of_near_copies_keeps_its_lines(spark):
    """Of thousands of copies with a few words changed each, none looks like another document by chance."""
    rng = np.random.default_rng(13)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(3000)]
    base = [list(rng.choice(words, 21)) for _ in range(6)]
    rows = []
    for _ in range(3000):
        lines = [list(x) for x in base]
        for _ in range(6):
            lines[rng.integers(6)][rng.integers(21)] = words[rng.integers(3000)]
        rows.append("\n".join(" ".join(x) for x in lines))
    got = line_dedup.drop_recurring(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert got.where("n_dropped > 0").count() == 0


def test_short_lines_and_word_fields_recur_with_more_holders(spark):
    rng = np.random.default_rng(12)
    word = lambda n=6: "".join(rng.choice(list("abcdefghij"), n))
    rows = []
    for i in range(60):
        lines = [" ".join(word() for _ in range(25)) for _ in range(3)]
        if i < 50:
            lines += ["Read more here", f"Posted by {word()} in category {word()} yesterday evening"]
        if i % 20 == 0:
            lines += ["See also", f"Kept by {word()} for reasons {word()} of its own"]
        rows.append("\n".join(lines))
    got = [r.text for r in line_dedup.drop_recurring(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["\n".join(x for x in t.split("\n") if not x.startswith(("Read", "Posted"))) for t in rows]


def test_recurring_lines_of_a_table_are_those_of_brute_force(spark, documents, texts):
    """Every line's holders counted over all texts in plain Python, copies told by the sets of shingles of the rest."""
    got = {r.doc_id: r for r in line_dedup.drop_recurring(documents).collect()}
    holders: dict = {}
    for i, t in texts.items():
        for x in {plain_tokens(x) for x in (t or "").encode().split(b"\n")}:
            if x:
                holders.setdefault(x, []).append(i)
    grams = lambda lines: {tuple(w[k : k + 3]) for w in lines for k in range(max(1, len(w) - 2)) if w}

    def rest(i, template):
        return grams([x.split() for x in texts[i].encode().split(b"\n") if plain_tokens(x) != template])

    agree = total = 0
    for i, t in texts.items():
        kept = set((got[i].text or "").split("\n"))
        for x in (t or "").split("\n"):
            template = plain_tokens(x.encode())
            mine = holders.get(template, [])
            if len(template) < 4 or len({texts[j] for j in mine}) < 2:
                want = False
            else:  # far apart if some two share less than a tenth, alike if all share more than a half
                rests = [r for r in (rest(j, template) for j in mine) if r]
                shares = [len(rests[0] & r) / len(rests[0] | r) for r in rests[1:]] or [1.0]
                if not (min(shares) < 0.1 or min(shares) > 0.5):
                    continue
                want = min(shares) < 0.1
            total += 1
            agree += (x not in kept) == want
    assert total > 1000 and agree >= 0.985 * total


@pytest.fixture(scope="module")
def lined(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for i in range(2000)]
    prose = lambda: " ".join(rng.choice(words, 20))
    passage = " ".join(rng.choice(words, 60))
    rows = []
    for i in range(40):
        lines = [prose() for _ in range(6)]
        if i < 10:
            lines.insert(3, passage if i % 2 else passage.replace(passage.split()[30], "varied" * (i + 1)))
        if 10 <= i < 20:
            lines.append(f"Copyright {1990 + i} of the same old house")
        rows.append((i, "\n".join(lines), 0))
    copies = [(100 + k, rows[30][1].replace(rows[30][1].split()[5], f"z{k}"), 0) for k in range(12)]
    return spark.createDataFrame(rows + copies, "doc_id long, text string, n_dropped int"), passage, dict((i, t) for i, t, _ in rows + copies)


@pytest.mark.parametrize("most", [line_dedup.TEMPLATES_BROADCAST, 0])
def test_recurring_lines_go_and_copies_stay(lined, most):
    docs, passage, real = lined
    got = {r.doc_id: r for r in line_dedup.drop_recurring(docs, most_broadcast=most).collect()}
    assert len(got) == len(real)
    for i, t in real.items():
        lines = t.split("\n")
        want = [x for k, x in enumerate(lines) if not (i < 10 and k == 3) and not x.startswith("Copyright")]
        assert got[i].text == "\n".join(want)
        assert (got[i].n_lines, got[i].n_dropped) == (len(lines), len(lines) - len(want))


def test_a_passage_of_unlike_documents_recurs_whatever_its_share(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghij"), 7)) for i in range(4000)]
    prose = lambda n: " ".join(rng.choice(words, n))
    passages = [prose(100) for _ in range(20)]
    rows = [f"{prose(40)}\n{p}\n{prose(40)}" for p in passages for _ in range(12)]
    shared = prose(20)
    heavy = [f"{prose(100)}\n{shared}" for _ in range(5)]
    rows += heavy + [heavy[0].replace(heavy[0].split()[k], f"z{k}") for k in range(50)]  # most holders are near copies of one
    got = [r.text for r in line_dedup.drop_recurring(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[:240] == ["\n".join(t.split("\n")[::2]) for t in rows[:240]]
    assert got[240:] == [t.split("\n")[0] for t in rows[240:]]


def test_a_line_of_two_unlike_documents_recurs(spark):
    rng = np.random.default_rng(7)
    prose = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 9000, n))
    passage, copied = prose(60), f"{prose(90)}\n{prose(30)}"
    rows = [f"{prose(80)}\n{passage}", f"{passage}\n{prose(50)}", copied, copied.replace(copied.split()[4], "other")]
    rows += [prose(20), prose(20)]
    rows[5] = f"{rows[4]}\n{rows[5]}"  # nothing but a line that another holds
    got = [r.text for r in line_dedup.drop_recurring(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [rows[0].split("\n")[0], rows[1].split("\n")[1], *rows[2:]]


def test_lines_of_odd_rows(odd, empty):
    rows = line_dedup.drop_recurring(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[3].text is None and by[3].n_lines == 0 and by[4].text == "" and by[4].n_lines == 1
    assert by[1].n_dropped == 0 and by[6].lang == "es"
    assert line_dedup.drop_recurring(empty).count() == 0


def test_columns_that_the_join_uses_itself_are_carried(spark, odd):
    """Input columns of the names that the plan adds, on the path by join."""
    clash = odd.select("*", F.lit(7).alias("row"), F.lit("g").alias("gone"), F.lit(1).alias("_row"), F.lit(2).alias("_gone"), F.lit(3).alias("held"), F.lit(4).alias("template"), F.lit("a").alias("dotted.name"))
    for most in (0, line_dedup.TEMPLATES_BROADCAST):
        rows = line_dedup.drop_recurring(clash, most_broadcast=most).collect()
        assert len(rows) == len(ODD)
        assert {(r.row, r.gone, r._row, r._gone, r.held, r.template, r["dotted.name"]) for r in rows} == {(7, "g", 1, 2, 3, 4, "a")}
        assert sorted(str(r.text) for r in rows) == sorted(str(r[1]) for r in ODD)
        assert line_dedup.drop_recurring(clash.limit(0), most_broadcast=most).count() == 0
