"""Problems 2, 5, 8 and 9 against brute force, with nulls, copies, empty and very long texts."""

import datetime
import json
import random
import re
import unicodedata

import numpy as np
import pytest

from sparkloom.llm import eval_leakage, near_duplicates, shared_spans, split_overlap

WORD = re.compile(r"[一-鿿]|[^\W一-鿿]+")
NOW = datetime.datetime(2026, 1, 1)
WORDS = [f"w{i}" for i in range(400)]


def runs(text, k=3):
    w = WORD.findall((text or "").lower())
    return set(zip(*[w[i:] for i in range(k)]))


def like(a, b):
    x, y = runs(a), runs(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def sentences(rng, n):
    words = [f"w{i}" for i in range(60)] + list("中文分词测试样本")
    return [" ".join(rng.choice(words) for _ in range(rng.randint(4, 9))) for _ in range(n)]


def variants(rng, count):
    base = [sentences(rng, rng.randint(1, 7)) for _ in range(count)]
    out = []
    for b in base:
        out.append(". ".join(b))
        for _ in range(rng.randint(0, 3)):
            c = list(b)
            if rng.random() < 0.5:
                rng.shuffle(c)
            t = ". ".join(c).split(" ")
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = f"n{rng.randrange(999)}"
            out.append(" ".join(t))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = variants(rng, 40) + ["", None, "one two", "one two three", "ONE two  three", "a b c d", "a b c e"] + ["same text of five words"] * 4
    texts.append("x y z " * 20_000)
    rows = [(f"s{i:03}", t, None if i % 7 else "", NOW, i, "clash") for i, t in enumerate(texts)] + [(None, "q", "q", NOW, 0, "")]
    rows += [(f"s{i:03}", texts[i], None if i % 7 else "", NOW, i, "again") for i in range(0, 20, 3)]
    df = spark.createDataFrame(rows, "sample_id string, prompt string, reference string, created_ts timestamp, rid int, text string")
    got = {(r[0], r[1]) for r in near_duplicates.near_duplicate_pairs(df).collect()}
    full = {f"s{i:03}": t for i, t in enumerate(texts)}
    ids = sorted(full)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if like(full[a], full[b]) >= 0.6}
    assert got == want and len(want) > 10
    groups = near_duplicates.near_duplicate_groups(df).collect()
    assert {r["id"] for r in groups} == {x for p in want for x in p}
    assert sum(r["links"] for r in groups) == 2 * len(want)
    of = {r["id"]: r["group_id"] for r in groups}
    assert all(of[a] == of[b] for a, b in want) and all(g <= i for i, g in of.items())


@pytest.mark.parametrize("edge", [0, 12, 64])
def test_every_boundary_gives_the_same_pairs(spark, edge, monkeypatch):
    rng = random.Random(5)
    texts = variants(rng, 25)
    df = spark.createDataFrame([(f"s{i:03}", t, "", NOW) for i, t in enumerate(texts)], "sample_id string, prompt string, reference string, created_ts timestamp")
    monkeypatch.setattr(near_duplicates, "boundary", lambda *a: edge)
    got = {(r[0], r[1]) for r in near_duplicates.near_duplicate_pairs(df).collect()}
    want = {(f"s{i:03}", f"s{j:03}") for i in range(len(texts)) for j in range(i + 1, len(texts)) if like(texts[i], texts[j]) >= 0.6}
    assert got == want


def test_boundary_weighs_subsets_against_lists(spark):
    schema = "c1 long, c2 long, n int, runs array<long>, cost double"
    short = [(i, i, 6, list(range(5)), 4e3) for i in range(300)]  # short sets of frequent runs: subsets are cheaper
    long = [(1000 + i, i, 120, list(range(51)), 600.0) for i in range(300)]
    rare = [(5000 + i, i, 6, list(range(5)), 6.0) for i in range(300)]
    edge = lambda rows: near_duplicates.boundary(spark.createDataFrame(rows, schema), 0.6)
    assert edge(long) == 0 and edge(rare) == 0 and 9 <= edge(short + long) < 120 and edge(short) >= 6


def test_near_duplicates_shuffle_no_pairs_that_only_meet(spark):
    """Texts of common sentences meet in many lists; what is shuffled must follow the rows, not the meetings."""
    rng = random.Random(11)
    stock = [" ".join(rng.choice(WORDS) for _ in range(8)) for _ in range(150)]
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum({stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}.values())

    moved, size = [], []
    for n in (500, 2000):
        rows = [(f"s{i:05}", ". ".join(rng.sample(stock, 9)), "", NOW) for i in range(n)]
        df = spark.createDataFrame(rows, "sample_id string, prompt string, reference string, created_ts timestamp")
        before = written()
        near_duplicates.near_duplicate_pairs(df).collect()
        moved.append(written() - before)
        size.append(sum(len(r[1]) for r in rows))
    assert moved[1] - moved[0] < 4 * (size[1] - size[0])


def test_sketches_lose_no_pair():
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 1 << 63, rng.integers(1, 300)).astype(np.uint64) for _ in range(40)]
    for x in list(sets):
        keep = x[rng.random(len(x)) < 0.8]
        sets.append(np.concatenate([keep, rng.integers(0, 1 << 63, 1 + len(x) // 9).astype(np.uint64)]))
    n = np.array([len(x) for x in sets])
    words, bounds = near_duplicates.sketch_of(np.concatenate(sets), np.repeat(np.arange(len(sets)), n), n)
    assert (np.diff(bounds) == near_duplicates.sketch_words(n)).all()
    i, j = np.triu_indices(len(sets), 1)
    common = np.array([len(np.intersect1d(sets[x], sets[y])) for x, y in zip(i, j)])
    for threshold in (0.3, 0.6, 0.9):
        near = common >= threshold * (n[i] + n[j] - common) - 1e-9
        fits = near_duplicates.sketches_fit(n, words, threshold)
        ok = (n[i] >= threshold * n[j]) & (n[j] >= threshold * n[i])  # ranks and sizes are tried before
        assert near[ok].sum() == near.sum() and fits(i[ok], j[ok])[near[ok]].all()
        assert (fits.differ(i[ok], j[ok]) <= (n[i] + n[j] - 2 * common)[ok]).all()
    assert fits(i[ok], j[ok]).sum() < ok.sum() / 2


@pytest.mark.parametrize("most", [1, 3, 7, 100])
def test_cells_let_each_pair_of_a_list_meet_once(most):
    c1 = np.arange(40, dtype=np.int64)
    key = np.repeat(np.array([5, 9], np.uint64), 20)
    made, at, side = near_duplicates._cells(key, np.full(40, 20.0), c1, most)
    met = []
    for k in np.unique(made):
        own = np.flatnonzero(made == k)
        met += [(at[x], at[y]) for x in own for y in own if at[x] < at[y] and (side[x] == 0 or side[x] != side[y])]
    assert sorted(met) == [(x, y) for x in range(40) for y in range(x + 1, 40) if key[x] == key[y]]


@pytest.mark.parametrize(("cut", "chunk"), [(300_000, 2_000_000), (1, 1), (7, 50)])
def test_blocks_try_every_pair_of_a_list(cut, chunk, monkeypatch):
    monkeypatch.setattr(near_duplicates, "SLICE", cut)
    monkeypatch.setattr(near_duplicates, "CHUNK", chunk)
    rng = np.random.default_rng(6)
    sets = [rng.choice(900, rng.integers(1, 60), replace=False) for _ in range(60)]
    sets += [np.union1d(x[rng.random(len(x)) < 0.85], rng.choice(900, 2)) for x in sets]
    sets = [np.unique(x) for x in sets]  # the order of the runs is their number
    n = np.array([len(x) for x in sets], np.int32)
    grams = near_duplicates.mix(np.concatenate(sets).astype(np.uint64))
    words, _ = near_duplicates.sketch_of(grams, np.repeat(np.arange(len(sets)), n), n.astype(np.int64))
    count = (n - np.ceil(0.6 * n - 1e-9) + 1).astype(np.int32)
    key = np.concatenate([x[:k] for x, k in zip(sets, count)]).astype(np.uint32)
    code = np.concatenate([np.arange(k) for k in count]).astype(np.uint16)
    got = {(int(a), int(b)) for i, j in near_duplicates.pairs_in_block(np.arange(len(n)), n, words, count, key, code, 0.6) for a, b in zip(i, j)}
    common = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    want = {(a, b) for a in range(len(n)) for b in range(a + 1, len(n)) if common(a, b) >= 0.6 * (n[a] + n[b] - common(a, b)) and (sets[a].tolist() != sets[b].tolist())}
    assert want <= got and len(want) > 20 and len(got) < 2 * len(want)


def test_blocks_hold_what_one_task_can():
    assert near_duplicates.blocks(0, 0, 0.0, 6) == 6 and near_duplicates.blocks(10**7, 4 * 10**5, 24.0, 6) == 6
    for rows in (10**7, 10**8):
        n = near_duplicates.blocks(30 * rows, rows, 24.0, 6)
        assert 30 * rows * 6 / n < near_duplicates.BLOCK_BYTES and n * near_duplicates.BLOCK_BYTES < 2 * 30 * rows * 43


def test_boundary_keeps_subset_keys_below_the_list_entries(spark):
    rows = [(i, i, 120, list(range(50)), 1e9) for i in range(300)]
    assert near_duplicates.boundary(spark.createDataFrame(rows, "c1 long, c2 long, n int, runs array<long>, cost double"), 0.6) < 120


def evidence(text):
    parts = text.split(". ")
    items = [{"rank": i + 1, "text": p} for i, p in enumerate(parts)]
    random.Random(len(text)).shuffle(items)
    return json.dumps(items, ensure_ascii=False)


def test_split_overlaps_equal_brute_force(spark):
    rng = random.Random(3)
    texts = variants(rng, 50)
    splits = ["train", " TRAIN", "test", "Gate ", None, ""]
    rows = []
    for i, t in enumerate(texts):
        h = rng.choice([None, "", "pending", "0" * 64, f"{i % 9:064x}".replace("0", "b"), f"SHA256:{i % 9:064x}".replace("0", "B").replace("SHB", "SHA")])
        rows.append((f"t{i:03}", rng.choice(splits), "src", h, evidence(t), NOW))
    rows += [("x1", "train", "s", None, None, NOW), ("x2", "test", "s", None, "", NOW), ("x3", "test", None, None, '[{"rank": 1, "te', NOW), ("x4", "test", "s", None, "[]", NOW), ("x5", "gate", "s", None, '{"a": 1}', NOW), (None, "train", "s", "a" * 64, None, NOW)]
    rows += rows[:9]
    df = spark.createDataFrame(rows, "trace_id string, split string, source_dataset string, sample_hash string, evidence_items_json string, created_ts timestamp")

    def text_of(raw):
        try:
            return " ".join(x["text"] for x in sorted(json.loads(raw), key=lambda x: x["rank"]))
        except (TypeError, ValueError, KeyError):
            return ""

    def dig(h):
        h = re.sub("^sha256:", "", (h or "").strip().lower())
        return h if re.fullmatch("[0-9a-f]{64}", h) and len(set(h)) > 1 else None

    rec = {r[0]: ((r[1] or "").strip().lower(), dig(r[3]), text_of(r[4])) for r in rows if r[0]}
    train = [k for k, v in rec.items() if v[0] == "train"]
    other = [k for k, v in rec.items() if v[0] not in ("train", "")]
    want = {(a, b) for a in train for b in other if (rec[a][1] and rec[a][1] == rec[b][1]) or like(rec[a][2], rec[b][2]) >= 0.6}
    found = split_overlap.split_overlaps(df).collect()
    assert {(r["train_id"], r["other_id"]) for r in found} == want and len(found) == len(want) and want
    near = [r for r in found if r["likeness"]]
    assert near and all(0 < r["coverage_train"] <= 1 and 1 <= r["chained"] <= r["seeds"] for r in near if r["likeness"] < 1 and r["seeds"])
    report = split_overlap.overlap_report(df).collect()
    assert sum(r["records"] for r in report) == len([k for k, v in rec.items() if v[0]])
    assert sum(r["overlapping"] for r in report) == len({x for p in want for x in p})


@pytest.mark.parametrize("times", [1, 1000])
def test_split_overlaps_of_frequent_runs_across_a_length(spark, times):
    # texts of 16 to 21 runs against themselves plus one token; every run stands in the table ``times`` times
    rng = random.Random(8)
    rows, want = [], set()
    for i in range(40):
        w = [f"f{i}x{rng.randrange(900)}" for _ in range(18 + i % 6)]
        at = rng.randrange(len(w) + 1)
        more = [*w[:at], "added", *w[at:]]
        if like(" ".join(w), " ".join(more)) >= 0.6:
            want.add((f"a{i}", f"b{i}"))
        rows += [(f"a{i}", "train", " ".join(w)), (f"b{i}", "test", " ".join(more))]
        # the runs are made frequent by one record that has them again and again
        rows.append((f"c{i}", "train", " ".join([*w, *more] * (times // 2) + [f"c{i}y{j}" for j in range(200)])))
    df = spark.createDataFrame([(r, s, "src", None, evidence(t), NOW) for r, s, t in rows], "trace_id string, split string, source_dataset string, sample_hash string, evidence_items_json string, created_ts timestamp")
    got = {(r["train_id"], r["other_id"]) for r in split_overlap.split_overlaps(df).collect()}
    assert got == want and len(want) > 35


@pytest.mark.parametrize("copies", [15, 17, 1000])
def test_equal_three_token_texts_of_any_number(spark, copies):
    rows = [(f"a{i}", "train", "no evidence given") for i in range(copies)] + [("b", "test", "No evidence, given"), ("c", "gate", "no evidence")]
    df = spark.createDataFrame([(r, s, "src", None, evidence(t), NOW) for r, s, t in rows], "trace_id string, split string, source_dataset string, sample_hash string, evidence_items_json string, created_ts timestamp")
    got = [(r["train_id"], r["other_id"], r["likeness"], r["coverage_train"]) for r in split_overlap.split_overlaps(df).collect()]
    assert sorted(got) == sorted((f"a{i}", "b", 1.0, 1.0) for i in range(copies))


def test_align_takes_every_occurrence_of_a_run():
    from sparkloom.llm.kernels import Tokens, winnow

    def slow(left, right):
        both = Tokens([left, right])
        w = [left.split(), right.split()]
        g, bounds = both.grams(3)
        keep = winnow(g, bounds, split_overlap.WINDOW)
        at = [[(i - bounds[s], g[i]) for i in range(bounds[s], bounds[s + 1]) if keep[i]] for s in (0, 1)]
        mark, seeds = [set(), set()], [(x, y) for x, a in at[0] for y, b in at[1] if a == b]
        for x, y in seeds:
            i, e = 0, 3
            while x - i and y - i and w[0][x - i - 1] == w[1][y - i - 1]:
                i += 1
            while x + e < len(w[0]) and y + e < len(w[1]) and w[0][x + e] == w[1][y + e]:
                e += 1
            mark[0].update(range(x - i, x + e))
            mark[1].update(range(y - i, y + e))
        best = {}
        for x, y in sorted(seeds):
            best[x, y] = 1 + max((v for (i, j), v in best.items() if i < x and j < y), default=0)
        return len(mark[0]) / len(w[0]), len(mark[1]) / len(w[1]), len(seeds), max(best.values(), default=0)

    twice = "the crew found a blown fuse in the feeder"
    assert split_overlap.align(f"{twice} . {twice}", f"{twice} , {twice}")[:2] == (1.0, 1.0)
    rng = random.Random(11)
    for words in (3, 6, 40):
        for _ in range(60):
            make = lambda: [f"w{rng.randrange(words)}" for _ in range(rng.randint(3, 30))]
            core, more = make(), make()
            left, right = " ".join(make() + core + make() + core), " ".join(core + more + core + make())
            assert split_overlap.align(left, right) == pytest.approx(slow(left, right))
    assert split_overlap.align("x y z " * 20_000, "x y z " * 20_000 + "q")[0] == 1.0


def test_evidence_and_digest_forms(spark):
    assert split_overlap.evidence_text('[{"rank": 2, "text": "b"}, {"rank": 1, "text": "a"}, {"text": "z"}, 5]') == "a b z"
    assert split_overlap.evidence_text("[1") == split_overlap.evidence_text(None) == split_overlap.evidence_text("7") == ""
    d = "ab" * 32
    df = spark.createDataFrame([(d.upper(),), (f" sha256:{d}",), (f"0x{d}",), ("pending",), ("f" * 64,), (None,)], "h string")
    assert [r[0] for r in df.select(split_overlap.digest(df.h)).collect()] == [d, d, d, None, None, None]


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    items = [" ".join(f"i{j}_{rng.randrange(40)}" for _ in range(rng.randint(5, 40))) for j in range(12)] + ["短" * 3, "中文评测材料必须逐字出现在语料里才算泄漏否则不算数的"]
    items += [items[0].upper().replace(" ", " ,  ")]

    def norm(t):
        return WORD.findall(unicodedata.normalize("NFKC", (t or "").replace("​", "")).lower())

    docs = []
    for _ in range(60):
        w = norm(rng.choice(items))
        a = rng.randrange(max(len(w) - 3, 1))
        part = w[a : a + rng.randint(3, 30)]
        sep = "" if all(len(x) == 1 for x in part) else rng.choice([" ", ", ", "\n"])
        docs.append(" ".join(f"x{rng.randrange(99)}" for _ in range(5)) + " " + sep.join(part) + " tail")
    docs += [None, "", "ｉ０＿１", "y " * 50_000, items[3].replace("i", "ｉ"), items[4][:10] + "​" + items[4][10:]]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, item_id int")
    e = spark.createDataFrame([(100 + i, t) for i, t in enumerate(items)] + [(200, None)], "item_id long, text string")
    want = set()
    for i, t in enumerate(docs):
        w = norm(t)
        have = {tuple(w[a : a + 15]) for a in range(len(w) - 14)}
        for j, x in enumerate(items):
            y = norm(x)
            if any(tuple(y[a : a + 15]) in have for a in range(len(y) - 14)):
                want.add((i, 100 + j))
    assert {(r[0], r[1]) for r in eval_leakage.leaks(d, e).select("doc_id", "item_id").collect()} == want and want
    # a test set that is too large to be sent gives the same rows by a join of seeds
    whole = lambda **k: sorted((r[0], r[1], r[2], r[3], r[4], round(r[5], 9)) for r in eval_leakage.leaks(d, e, **k).collect())
    assert whole(block=200) == whole()
    assert sorted((r[0], r[1]) for r in eval_leakage.leaks(d, e, 6, 200).collect()) == sorted((r[0], r[1]) for r in eval_leakage.leaks(d, e, 6).collect())
    assert eval_leakage.leaks(d.limit(0), e, block=200).count() == 0
    assert eval_leakage.leaks(d.limit(0), e).count() == 0 and eval_leakage.leaks(d, e.limit(0)).count() == 0


def test_tiles_cover_reordered_passages():
    import numpy as np

    item = np.arange(40, dtype=np.uint64)
    doc = np.concatenate([item[20:40], np.array([900], np.uint64), item[0:20]])
    found = eval_leakage.tiles(doc, item, 6)
    assert sorted(found) == [(0, 20, 20), (21, 0, 20)]
    same = np.full(30, 7, np.uint64)
    assert sum(t[2] for t in eval_leakage.tiles(same, same, 5)) == 30


def test_shared_spans_equal_brute_force(spark):
    rng = random.Random(6)
    alphabet = "abcdefgh中文 \n"
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    blocks = [make(rng.randint(100, 500)) for _ in range(12)]
    docs = []
    for _ in range(50):
        parts = [make(rng.randint(0, 80))]
        for b in rng.sample(blocks, rng.randint(0, 2)):
            a = rng.randrange(60)
            parts += [b[a : a + rng.randint(150, 500)], make(rng.randint(0, 50))]
        docs.append("".join(parts))
    docs += [None, "", "z" * 239, "z" * 240, "z" * 300, "q" * 5000 + "p", "q" * 4000, docs[0], docs[0], docs[1].upper(), make(60_000) + blocks[0][:400]]
    df = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(docs)] + [(3, docs[3], b"y")], "doc_id long, text string, sig binary")
    grams = [{(t or "")[a : a + 240] for a in range(len(t or "") - 239)} for t in docs]
    want = {(i, j) for i in range(len(docs)) for j in range(i + 1, len(docs)) if grams[i] & grams[j]}
    got = [(r[0], r[1]) for r in shared_spans.shared_pairs(df).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 10
    cover = {r["doc_id"]: r for r in shared_spans.shared_coverage(df).collect()}
    assert set(cover) == {x for p in want for x in p}
    for i, r in cover.items():
        mark = [False] * len(docs[i])
        others = set().union(*[grams[j] for j in range(len(docs)) if j != i])
        for a in range(len(docs[i]) - 239):
            if docs[i][a : a + 240] in others:
                mark[a : a + 240] = [True] * 240
        assert r["shared_chars"] == sum(mark), i
    assert shared_spans.shared_pairs(df.limit(0)).count() == 0


def test_coverage_of_a_passage_in_most_texts(spark):
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    head, middle = make(500), make(700)
    docs = [(head if i % 3 == 0 else "") + make(90 + i % 40) + (middle[i % 5 :] if i % 2 else "") + make(80) for i in range(1200)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    few = shared_spans.shared_stretches_of_texts(df.filter("doc_id < 300")).count()
    assert shared_spans.shared_stretches_of_texts(df).count() < 5 * few  # in proportion to the texts, not to their pairs
    got = {r["doc_id"]: (r["shared_chars"], r["stretches"]) for r in shared_spans.shared_coverage(df).collect()}
    holder: dict = {}
    for i, t in enumerate(docs):
        for a in range(len(t) - 239):
            w = t[a : a + 240]
            holder[w] = i if holder.get(w, i) == i else -1
    for i, t in enumerate(docs):
        mark = [False] * len(t)
        for a in range(len(t) - 239):
            if holder[t[a : a + 240]] == -1:
                mark[a : a + 240] = [True] * 240
        runs_of = sum(m and not (x and mark[x - 1]) for x, m in enumerate(mark))
        assert got.get(i, (0, 0)) == (sum(mark), runs_of), i


def test_maximal_repeats():
    rng = random.Random(9)
    core = "".join(rng.choice("abcdefgh") for _ in range(400))
    left, right = "XX" + core + "YY", "ZZZ" + core + "WW"
    assert shared_spans.maximal_repeats(left, right, 240, 180) == [(2, 3, 400)]
    assert shared_spans.shared_stretches("a" * 9000, "a" * 9000 + "b") == ([(0, 9000)], [(0, 9000)])


def test_pairs_of_empty_tables(spark):
    e = spark.createDataFrame([], "sample_id string, prompt string, reference string, created_ts timestamp")
    assert near_duplicates.near_duplicate_pairs(e).count() == 0 and near_duplicates.near_duplicate_groups(e).count() == 0
    t = spark.createDataFrame([], "trace_id string, split string, source_dataset string, sample_hash string, evidence_items_json string, created_ts timestamp")
    assert split_overlap.split_overlaps(t).count() == 0
