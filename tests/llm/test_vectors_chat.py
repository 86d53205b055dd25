"""Vector codes, hard negatives and chat formatting against brute force and awkward tables."""

import collections
import hashlib
import math

import numpy as np
import pytest

from wayfold.llm import chat, common, lloyd, negatives, vectors

VECTORS = "vec_id long, label int, embedding array<float>, row long, v string, chunk int, block int, n int, score long"


def _table(spark, rows):
    return spark.createDataFrame([(*r, 9, "v", 1, 2, 3, 4) for r in rows], VECTORS)


@pytest.fixture(scope="module")
def odd_rows():
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 4)), [float(x) for x in rng.normal(size=16) * rng.choice([0.01, 0.3, 2.0])]) for i in range(400)]
    rows += [(400 + i, None if i % 9 == 0 else 2, rows[3][2]) for i in range(200)]  # one vector, a third of all rows
    rows += [rows[7], rows[7], rows[100], (None, 1, rows[5][2]), (None, 1, rows[8][2]), (700, 1, None), (701, 1, [1.0] * 15 + [None]), (702, 1, [math.nan] * 16)]
    return rows + [(703, 1, [math.inf] * 16), (704, 1, [1.0] * 15), (705, 1, []), (706, 3, [0.0] * 16), (-100, 2, [0.5] * 16)]


def whole(rows, factor):
    kept = [r for r in rows if r[2] is not None and len(r[2]) == 16 and all(x is not None and math.isfinite(x) for x in r[2])]
    return [(i, label, [math.floor(float(np.float32(x)) * factor) for x in v]) for i, label, v in kept]


def brute_codes(rows, parts=8, entries=16, rounds=6):
    rows = whole(rows, 4096)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    width = 16 // parts
    books = [[r[2][p * width : (p + 1) * width] for r in order] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[p * width :], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for _, _, v in rows]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(order)):
                own = [r[2][p * width : (p + 1) * width] for r, f in zip(rows, found) if f[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    done = [(i, label, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for (i, label, _), f in zip(rows, assign())]
    totals = collections.Counter()
    for _, label, _, error in done:
        totals[label] += error
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(*d, totals[d[1]], sha) for d in done]


def test_codes_by_brute_force_on_awkward_rows(spark, odd_rows):
    found = lloyd.codes_of(_table(spark, odd_rows)).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, brute_codes(odd_rows)))


def test_few_rows_and_none_give_codes(spark, odd_rows):
    few = odd_rows[:3]
    assert sorted(map(str, map(tuple, lloyd.codes_of(_table(spark, few)).collect()))) == sorted(map(str, brute_codes(few)))
    for rows in ([], [(1, 1, None)]):
        found = lloyd.codes_of(_table(spark, rows))
        assert found.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"] and found.count() == 0
    with pytest.raises(ValueError):
        lloyd.codes_of(_table(spark, few), parts=5)


def test_running_sums_equal_sums_anew():
    """Plus and minus contributions over many random reassignments give what a fresh sum gives."""
    rng = np.random.default_rng(1)
    v, parts, entries = rng.integers(-5000, 5000, size=(300, 12)), 4, 5
    state, before = np.zeros((parts, entries, 4), np.int64), None
    for _ in range(5):
        codes = rng.integers(0, entries, size=(300, parts)).astype(np.uint8)
        if before is not None:
            codes[50:] = before[50:]  # most stay
        sums = {}
        n = lloyd.changes(v, codes, before, sums)
        assert n == (1200 if before is None else int((codes != before).sum()))
        for (p, e), s in sums.items():
            state[p, e] += s
        for p in range(parts):
            for e in range(entries):
                own = v[codes[:, p] == e, p * 3 : p * 3 + 3]
                assert state[p, e].tolist() == [len(own), *own.sum(0)]
        before = codes


def test_rounds_join_without_an_exchange(spark, odd_rows):
    """Vectors and assignments are read by buckets: joining them shuffles neither."""
    chunks = lloyd._bucketed(vectors.pack(vectors.integers(_table(spark, odd_rows), 4096)), "t_vectors")
    codes = lloyd._bucketed(chunks.select("chunk", "n"), "t_codes")
    plan = chunks.hint("merge").join(codes.select("chunk"), "chunk")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    lloyd._drop(chunks, codes)


def brute_negatives(rows, every=100, positives=5, negatives=10):
    rows = [(i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, v) for i, label, v in whole(rows, 256) if label is not None]
    last = lambda i: (i is None, i or 0)
    out = []
    for k, (a, label, v) in enumerate(rows):
        if a is None or a % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), last(i), i, other) for j, (i, other, w) in enumerate(rows) if j != k), key=lambda s: s[:2])
        for s, _, p, _ in [x for x in scored if x[3] == label][:positives]:
            good = [x for x in scored if x[3] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(a, p, r + 1, n[2], -s, -n[0]) for r, n in enumerate(good)]
    return out


@pytest.mark.parametrize("every", [100, 3])
def test_negatives_by_brute_force_on_awkward_rows(spark, odd_rows, every, monkeypatch):
    """Several blocks, buckets and stripes; a third of all rows has one vector."""
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(vectors, "CHUNK", 20)
    found = negatives.hard_negatives(_table(spark, odd_rows), every=every).collect()
    wanted = brute_negatives(odd_rows, every)
    assert len(wanted) > 100 and sorted(map(str, map(tuple, found))) == sorted(map(str, wanted))


def test_no_vectors_or_no_anchors_give_no_negatives(spark, odd_rows):
    for rows in ([], [(100, None, [1.0])], odd_rows[1:50], [(100, 1, [1.0, 2.0])]):
        assert negatives.hard_negatives(_table(spark, rows)).count() == 0


def test_short_buckets_are_not_sent_and_not_compared(spark):
    """Buckets under the norm that the lowest window needs aren't dealt out; within a task anchors end by their k-th score."""
    one = lambda x: np.array([[x]], np.int64)
    v = np.array([[100, 0]])
    block = negatives.Block(np.array([0]), np.array([1]), v, one(3000), one(9000), 1, same=False)
    block.see(np.array([1]), np.array([1]), np.array([2]), np.array([[80, 5]]), 81.0)
    assert block.least[0, 0] == 8000 and len(block.alive) == 1
    block.see(np.array([2]), np.array([2]), np.array([2]), np.array([[79, 0]]), 79.0)
    assert len(block.alive) == 0 and block.best[0, 0][1].tolist() == [1]
    rows = [(i, i % 2, [2.0 ** -(i // 8), 0.0]) for i in range(1, 201)]
    table = vectors.integers(_table(spark, rows), 1 << 16)
    buckets = vectors.pack(table.orderBy(vectors.norm(table["v"]).desc()).coalesce(1))
    blocks = spark.sql("SELECT 0 AS block, 16777216.0D AS need, 1 AS n, 2 AS d, 0.0D AS top, X'' AS row, X'' AS vec_id, X'' AS has_id, X'' AS label, X'' AS v, X'' AS lo, X'' AS hi")
    assert negatives._pairs(blocks, buckets, 1, 1).where("lo is null").count() == 0


CHATS = [
    (1, 0, "user", "a"), (1, None, None, None), (1, 1, "a: b=\\: ", "x\\</turn>\n### User: </</turn>#### "), (None, 0, "tool", ""), (2, 0, "assistant", "\\"),
    (2, 0, "assistant", "\\"), (3, 0, "user", "é" * 400_000 + "</turn>" * 1000), (3, 1, "assistant", "\n</turn>\n<\\/turn>\\\\"), (4, 0, "system", "s"), (4, 1, "user", ""),
    (4, 2, "assistant", "😀### "), (4, 3, "user", "u"), (5, 1, "user", "only"), (6, 0, "system", "s"), (6, 1, "assistant", "too early"), (7, 0, "", None),
]


@pytest.fixture(scope="module")
def chats(spark):
    rows = [(*r, ["x"], "t", 1) for r in CHATS]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments array<string>, turns string, k int")


def test_chats_by_brute_force_on_awkward_rows(spark, chats):
    groups = collections.defaultdict(list)
    for conv, turn, role, text in CHATS:
        groups[conv].append((turn, role, text or ""))
    stored = common.stash(chat.format_chats(chats), "t-chats")
    found = {r.conv_id: r for r in chat.digests(stored).collect()}
    assert set(found) == set(groups)
    nexts = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", r[2]))
        f, learnt = found[conv], "".join(r[2] for r in rows if r[1] == "assistant")
        assert f.n_turns == len(rows)
        assert f.turns_sha256 == hashlib.sha256("".join(f"{r[1] or ''}\n{r[2]}\n" for r in rows).encode()).hexdigest()
        assert (f.loss_chars, f.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        state, refused = None, -1
        for k, (_, role, _) in enumerate(rows):
            if role not in nexts[state]:
                refused = k
                break
            state = role
        assert (f.valid, f.refused_turn, f.complete) == (refused < 0, refused, refused < 0 and state == "assistant"), conv


def test_control_strings_are_marks_alone(spark, chats):
    """In the formatted text the template's strings stand once a turn; texts come back as they were."""
    text = chat.formatted(chat.F.col("segments"))
    rows = chat.format_chats(chat.with_adverse(spark, chats)).select("conv_id", text.alias("t"), chat.turns_of(text).alias("turns")).collect()
    for r in rows:
        assert r.t.count("</turn>") == r.t.count("### ") == len(r.turns)
    back = sorted(str((r.conv_id, t.role, t.text)) for r in rows for t in r.turns)
    assert back == sorted([str((c, role, text or "")) for c, _, role, text in CHATS] + [str((-7, role, chat.ADVERSE)) for role in ("user", "assistant")])


def test_another_template_and_no_rows(spark, chats):
    t = chat.Template(labels={"q": "Q", "a": "A"}, opening="<|", between="|>", ending="<|end|>", learnt=("a", "q"), steps={"start": {"q": "x"}, "x": {"a": "start"}}, ends=("start",))
    rows = spark.createDataFrame([(1, 0, "q", "<|A|>"), (1, 1, "a", "<|end|>"), (2, 0, "a", "no")], "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat.format_chats(rows, t).select("*", chat.formatted(chat.F.col("segments")).alias("f"), chat.learnt_text(chat.F.col("segments")).alias("l")).collect()}
    assert found[1].f == "<|Q|><\\|A|><|end|>\n<|A|><\\|end|><|end|>\n" and found[1].l == "<|A|><|end|>"
    assert (found[1].valid, found[1].complete, found[2].valid) == (True, True, False)
    assert chat.digests(chat.format_chats(chats.limit(0))).count() == 0
    for bad in ({"ending": "abab"}, {"ending": "<\\t>"}, {"labels": {"a": "A", "b": "A"}}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


def test_formatting_runs_in_the_jvm_alone(spark, chats):
    plan = chat.digests(chat.format_chats(chat.with_adverse(spark, spark.range(1).selectExpr("id conv_id", "id turn", "'user' role", "'x' text"))))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "ExistingRDD"))
