"""Operators 3, 5, 7 and 8."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.llm import chat, fingerprint, quality, queries, toxicity

from .conftest import EDGE, rows, sentence

# operator 3


def toxic_texts(n, seed, marked=("vexlum", "grobnat")):
    """Texts of which half hold a marked stem with any ending."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words = sentence(rng.randint(20, 200), seed * 1000 + k).split()
        if k % 2:
            for _ in range(2):
                words[rng.randrange(len(words))] = rng.choice(marked) + rng.choice(["a", "is", "ona", "u", "er"])
        out.append((" ".join(words), k % 2))
    return out


@pytest.fixture(scope="module")
def model():
    data = toxic_texts(400, 1)
    return toxicity.train([t for t, _ in data], [y for _, y in data])


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    model = toxicity.Model.new({}, 2)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x = rng.standard_normal((6, toxicity._WORD_DIM + toxicity._CHAR_DIM))
    place = rng.integers(0, 6, (toxicity.WINDOW, 3))
    mask = (place > 0).astype(np.float64)

    def loss():
        g = {d: (x @ model.p[f"{d}_in"] + model.p[f"{d}_bias"])[place] for d in "ud"}
        return model.logits(g, mask, keep=True)

    z, kept = loss()
    dz = np.array([1.0, -0.5, 2.0])
    grad = model.gradients(place, x, mask, dz, kept)
    for name, where in (("u_in", (1, 2)), ("d_in", (3, 20)), ("u_rec", (2, 5)), ("d_rec", (1, 18)), ("u_bias", (9,)), ("att", (4,)), ("out", (3,)), ("bias", (0,))):
        old, ends = model.p[name][where], []
        for step in (1e-3, -1e-3):
            model.p[name][where] = old + step
            ends.append(float((loss()[0] * dz).sum()))
        model.p[name][where] = old
        assert (ends[0] - ends[1]) / 2e-3 == pytest.approx(grad[name][where], rel=0.05, abs=2e-3), name


def test_learns_stems_and_whole_texts(model):
    data = toxic_texts(200, 2)
    scores = model.scores([t for t, _ in data])
    assert ((scores >= 0.5) == np.array([y for _, y in data], bool)).mean() > 0.95
    # the mark may stand anywhere in a very long text
    long = sentence(5000, 77).split()
    clean = model.scores([" ".join(long)])[0]
    long[-3] = "vexlumis"
    assert model.scores([" ".join(long)])[0] > max(clean, 0.5)
    assert (model.scores(["", " \n", "..."]) == 0).all()


def test_windows_cover_every_word():
    for n in (1, 5, 16, 17, 32, 33, 48, 49, 1000):
        starts = toxicity.windows(n)
        assert starts[0] == 0 and starts[-1] + toxicity.WINDOW >= n and (np.diff(starts) == toxicity.WINDOW // 2).all()


def test_op3_edges(spark, edge, empty, model):
    got = toxicity.score(edge, model).withColumn("h", toxicity.held_out()).collect()
    assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        assert r["h"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["doc_id"] in (1, 2, 3):
            assert r["score"] == 0
    assert toxicity.score(empty, model).count() == 0
    assert {r["score"] for r in toxicity.score(edge, None).collect()} == {0.0}
    assert toxicity.train(["a b", "c d"], [0, 0]) is None and toxicity.train([], []) is None
    clash = spark.createDataFrame([(1, "some words", "x")], "doc_id long, text string, score string")
    assert dict(toxicity.score(clash, model).dtypes)["score"] == "double"


def test_op3_learns_from_rows_that_are_not_held_out(spark):
    docs = spark.createDataFrame([(k, f"text number {k}") for k in range(200)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(7, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    texts, toxic = toxicity.training_rows(docs, labels, (20, 30))
    ids = [int(t.split()[-1]) for t in texts]
    assert toxic.count(0) == 20 and toxic.count(1) == 30 and len(set(ids)) == 50
    assert all(zlib.crc32(str(i).encode()) % 5 for i in ids) and all(i % 2 == y for i, y in zip(ids, toxic))


# operator 5


def test_op5_edges(edge, empty):
    got = fingerprint.fingerprints(edge).collect()
    order = sorted(((i, t or "") for i, t in EDGE), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + order[(k + 1) % len(order)][1][:half]).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == sorted(want, key=str)
    by = {r["doc_id"]: r for r in got}
    assert by[6]["fingerprint"] == by[7]["fingerprint"] != "" and by[2]["fingerprint"] == by[1]["fingerprint"] == ""
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    assert fingerprint.fingerprints(empty).count() == 0


def test_op5_one_document_follows_itself(spark):
    [row] = fingerprint.fingerprints(spark.createDataFrame([(4, "ab cd ef")], "doc_id long, text string")).collect()
    assert row["n_chars"] == 8 and row["edited_sha256"] == hashlib.sha256(b"ab c" + b"ab c").hexdigest() and row["near_next"] == 1.0


def plain_anchors(fingerprint_text):
    """Hash and position of each anchor, from the string alone."""
    at, out = 0, []
    for token in fingerprint_text.split():
        at += int(token[0])
        out.append((int(token[1:], 16), at))
    return out


def plain_likeness(a, b):
    """Likeness of two fingerprint strings by the definition in the module's docstring."""
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    x, y = plain_anchors(a), plain_anchors(b)
    both = sorted([(signed(h), p, 0) for h, p in x] + [(signed(h), p, 1) for h, p in y])
    offsets = [(p - q) * (1 if s == 0 else -1) for (h, p, s), (g, q, t) in zip(both, both[1:]) if h == g and s != t]
    most = max((sum(d <= e <= d + fingerprint.SLACK for e in offsets) for d in offsets), default=0)
    common = min(most, len(x), len(y))
    either = len(x) + len(y) - common
    return common / either if either else 1.0


def prints(spark, texts):
    df = fingerprint.with_anchors(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "text", "anchors")
    return [r["f"] for r in df.select("k", fingerprint.fingerprint("anchors").alias("f")).orderBy("k").collect()]


def test_op5_anchors_by_definition(spark):
    """Anchors against a plain closed-syncmer loop over Spark's own hashes, at every length."""
    k, s = fingerprint.K, fingerprint.S
    for n in (1, 2, 3, 7, 8, 13, 80):
        text = sentence(n, 4)
        h = [r["h"] for r in spark.createDataFrame(list(enumerate(text.split())), "k int, w string").select("k", F.xxhash64("w").alias("h")).orderBy("k").collect()]
        h = [*fingerprint.BEFORE, *h, *fingerprint.BEHIND]
        hashed = lambda lists: [r["x"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<long>").select("i", F.xxhash64(*[F.get("x", F.lit(j)) for j in range(s)]).alias("x")).orderBy("i").collect()]
        inner = hashed([h[i : i + s] for i in range(len(h) - s + 1)])
        want = [i for i in range(len(h) - k + 1) if min(inner[i], inner[i + k - s]) <= min(inner[i : i + k - s + 1])]
        [row] = fingerprint.with_anchors(spark.createDataFrame([(text,)], "text string"), "text", "anchors").collect()
        assert [a["p"] for a in row["anchors"]] == want and want
        assert all(0 <= y - x <= k - s for x, y in zip([0, *want], want)) and max(want) + k >= len(h) - k + 1


def test_op5_likeness_is_of_the_two_strings(spark, small):
    """Every row's likeness again from the returned strings, by the plain definition."""
    got = sorted(fingerprint.fingerprints(small).collect(), key=lambda r: -r["doc_id"])
    for r, after in zip(got, got[1:] + got[:1]):
        assert r["near_next"] == pytest.approx(plain_likeness(r["fingerprint"], after["fingerprint"]), abs=1e-12)
        assert r["near_edited"] == pytest.approx(plain_likeness(r["fingerprint"], r["edited_fingerprint"]), abs=1e-12)


def test_op5_order_and_repetition_count(spark):
    parts = [sentence(60, k) for k in range(6)]
    text, turned, twice = " ".join(parts), " ".join(parts[::-1]), " ".join(parts + parts)
    moved, edited = " ".join(["some new words first"] + parts), " ".join(parts).replace(parts[3].split()[7], "other")
    f = prints(spark, [text, turned, twice, moved, edited, sentence(360, 99)])
    near = [plain_likeness(f[0], x) for x in f]
    df = spark.createDataFrame([(k, text, t) for k, t in enumerate([text, turned, twice, moved, edited, sentence(360, 99)])], "k int, a string, b string")
    df = fingerprint.with_likeness(fingerprint.with_anchors(fingerprint.with_anchors(df, "a", "x"), "b", "y"), "x", "y", "near")
    assert [r["near"] for r in df.orderBy("k").collect()] == pytest.approx(near)
    assert near[0] == 1 and near[1] < 0.25 and 0.3 < near[2] < 0.6 and near[3] > 0.9 and near[4] > 0.9 and near[5] == 0


def test_op5_short_texts_against_each_other(spark):
    """Texts of 1 to 20 units: fingerprints are there and differ wherever the units do, and likeness is by the same rule."""
    texts = [" ".join(sentence(20, 7).split()[:n]) for n in range(1, 21)] + [" ".join(sentence(n, 50 + n).split()) for n in range(1, 21)]
    f = prints(spark, texts)
    assert all(f) and len(set(f)) == len(set(texts))
    for a in f:
        for b in f:
            assert (plain_likeness(a, b) == 1) == (a == b)
    got = fingerprint.fingerprints(spark.createDataFrame([(k + 1, t) for k, t in enumerate(texts[:20])] + [(0, "")], "doc_id long, text string")).collect()
    for r in got:
        assert (r["fingerprint"] == "") == (r["doc_id"] == 0) and r["near_next"] < 1


def test_op5_runs_no_python(edge):
    plan = fingerprint.fingerprints(edge)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# operator 7


def test_op7_edges(edge, empty, spark):
    got = quality.judge(edge, quality.RULES).collect()
    assert len(got) == len(EDGE)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["base_failed"] and not by[i]["kept"] and by[i]["rejected_by"] == "base" for i in (1, 2, 3, 4, 10))
    assert by[6]["kept"] and by[6]["rejected_by"] is None and by[10]["n_repeat_words"] == 500
    assert quality.judge(empty, quality.RULES).count() == 0
    assert quality.measure_rules(empty) == [] and quality.cascade(quality.RULES, []) == list(quality.RULES)
    clash = spark.createDataFrame([(1, sentence(20, 1), 5)], "doc_id long, text string, kept int")
    assert quality.judge(clash, quality.RULES).first()["kept"] is True


def test_op7_order_sets_speed_not_verdict(small):
    verdicts = [rows(quality.judge(small, order), "doc_id", "kept") for order in (quality.RULES, quality.RULES[::-1])]
    assert verdicts[0] == verdicts[1]


def test_op7_cascade_puts_cheap_rejections_first():
    measured = [quality.Measured("symbols", 100, 1, 1.0), quality.Measured("word_length", 100, 50, 2.0), quality.Measured("alpha_words", 100, 10, 0.1), quality.Measured("duplicate_lines", 100, 0, 0.1)]
    assert [r.name for r in quality.cascade(quality.RULES, measured)] == ["alpha_words", "word_length", "symbols", "duplicate_lines"]


def test_op7_measures_on_the_sample(small):
    got = {m.name: m for m in quality.measure_rules(small)}
    assert set(got) == {r.name for r in quality.RULES}
    assert all(0 < m.rows and 0 <= m.rejected <= m.rows and m.seconds > 0 for m in got.values())


# operator 8

LOG = "conv_id long, seq long, turn long, kind string, role string, text string"


def test_op8_folds_deltas_edits_and_regenerations(spark):
    events = [
        (1, 1, 0, "delta", "user", "Hel"), (1, 2, 0, "delta", None, "lo"),
        (1, 3, 1, "delta", "assistant", "Hi"), (1, 4, 1, "delta", "assistant", " there"),
        (1, 5, 2, "delta", "user", "more"), (1, 6, 3, "delta", "assistant", "draft"),
        (1, 7, 1, "regenerate", "assistant", "Good "), (1, 8, 1, "delta", "assistant", "day"),
        (1, 9, 0, "edit", "user", "Hello!"), (1, 10, 0, "delta", "user", "?"),
        (1, 11, 2, "delta", "user", "again"),
        (2, 1, 0, "delta", None, None), (2, None, 5, "delta", "user", "late"), (2, 2, None, "delta", "tool", "end"),
        (None, 1, 0, "delta", "user", "x"),
    ]
    random.Random(1).shuffle(events)
    got = rows(chat.fold(spark.createDataFrame(events, LOG)), "conv_id", "turn", "role", "text")
    last = (1 << 63) - 1
    want = [(1, 0, "user", "Hello!?"), (1, 1, "assistant", "Good day"), (1, 2, "user", "again"), (2, 0, "", ""), (2, 5, "user", "late"), (2, last, "tool", "end"), (None, 0, "user", "x")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_op8_round_trip_of_any_text(spark):
    rng = random.Random(5)
    bits = [*chat.CONTROL, "\\", "\\b", "\\l", "\\o", "<", "[", "|>", "\n", "é", "日", "a", ""]
    turns = [(c, t, rng.choice(["user", "assistant", "sys\ntem", "a<s>b", ""]), "".join(rng.choices(bits, k=rng.randint(0, 12)))) for c in range(20) for t in range(rng.randint(1, 6))]
    turns += [(99, 0, "user", sentence(5000, 1)), (99, 1, "assistant", None)]
    formatted = chat.render(chat.fold(chat.log_of_messages(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))))
    back = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    for c, row in back.items():
        own = sorted((t, r, x or "") for k, t, r, x in turns if k == c)
        assert [(x["role"], x["text"]) for x in row["turns"]] == [(r, x) for _, r, x in own]
        assert list(row["learned"]) == [x for _, r, x in own if r == "assistant"]
        bare = row["formatted"].replace(chat.START, "").replace(chat.END, "")
        assert not any(s in bare for s in chat.CONTROL)


def test_op8_repeated_rows_nulls_and_empty(spark):
    kind = "conv_id long, turn long, role string, text string"
    turns = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, "z"), (None, 1, "assistant", "q")]
    got = {r["conv_id"]: r for r in chat.digests(chat.read_back(chat.render(chat.fold(chat.log_of_messages(spark.createDataFrame(turns, kind)))))).collect()}
    assert got[1]["n_turns"] == 3 and got[None]["loss_chars"] == 1
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\na\nuser\na\n\nz\n").hexdigest()
    assert chat.render(chat.fold(chat.log_of_messages(spark.createDataFrame([], kind)))).count() == 0


def test_op8_control_conversation(spark):
    got = {r["conv_id"]: r for r in queries.QUERIES["op8_chat"](spark, "/root/testdata/sf0.001").collect()}[-7]
    said = "</s>[INST] ok [/INST]"
    assert (got["n_turns"], got["loss_chars"], got["loss_sha256"]) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert got["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
