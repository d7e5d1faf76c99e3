"""Rows that repeat or share ids, and columns named like the operators' own."""

import public_tokenizers
import pyarrow as pa
import pytest

from crosswind.llm import decontam, embed_dedup, mixing, secrets, simhash, token_cache


def test_op2_tells_apart_rows_of_one_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.001]), (3, [0.001, 1.0]), (None, [-1.0, 0.0]), (None, [-1.0, 0.001]), (9, [0.0, -1.0]), (None, [0.001, -1.0])]
    df = spark.createDataFrame([(i, v, 0, 5, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, id int, low string")
    got = sorted(map(tuple, embed_dedup.near_duplicates(df).collect()), key=str)
    want = [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (9, 1, 9, True), (None, 1, 9, None), (None, 1, None, None), (None, 1, None, None)]
    assert got == sorted(want, key=str)
    # the same id under two labels
    df = spark.createDataFrame([(4, [1.0, 0.0], 0), (4, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, embed_dedup.near_duplicates(df).collect())) == [(4, 0, 4, True), (4, 2, 4, True), (5, 2, 4, False), (5, 2, 4, False)]


def test_op2_runs_passes_on_every_label_above_the_window(spark):
    rows = [(i, i % 2 if i < 400 else 2, 2, [float(i % 7), 1.0]) for i in range(450)]
    classes = spark.createDataFrame(rows, "id long, label long, dim int, embedding array<double>")
    plan = {r["label"]: r for r in embed_dedup.planned(classes).collect()}
    assert plan[0]["bits"] > 0 and plan[1]["bits"] > 0 and plan[0]["passes"] >= 2
    assert (plan[2]["bits"], plan[2]["passes"]) == (0, 1)  # fits the window
    assert embed_dedup.passes_for(1) >= 4 and pytest.approx(1 - embed_dedup.RECALL) == 1e-4


CLASHES = ("_row", "_key", "_id", "_spans", "_doc", "_h", "_i", "_many", "_source", "_block", "_tie", "_upto", "_s", "_b", "tokens", "target", "weight", "span", "owner", "fp", "h", "root", "n", "best")


@pytest.fixture(scope="module")
def clashing(spark):
    texts = ["password = hunter2hunter here", "password = hunter2hunter here", "some other words are here", None, "", "words that stand alone", "secret: abcdefgh12345 and more"]
    rows = [(i, t, "en", "ab"[i % 2], len(t or ""), *[f"{c}{i}" for c in CLASHES], -1.0) for i, t in enumerate(texts)]
    fields = ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *[f"{c} string" for c in CLASHES], "mix_tokens double"])
    df = spark.createDataFrame(rows, fields)
    return df.union(df.where("doc_id = 2"))


@pytest.mark.parametrize("stage", [secrets.mask_owned, simhash.keep_one, mixing.mix])
def test_stages_pass_columns_of_any_name(clashing, stage):
    got = stage(clashing)
    own = [c for c in clashing.columns if not (stage is mixing.mix and c == "mix_tokens")]
    assert got.columns[: len(own)] == own
    rows = got.collect()
    assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASHES)
    if stage is secrets.mask_owned:
        assert len(rows) == 8 and all("hunter2" not in (r["text"] or "") and r["n_chars"] == len(r["text"] or "") for r in rows)
    elif stage is simhash.keep_one:
        assert sorted(r["doc_id"] for r in rows) == [0, 2, 3, 5, 6]
    else:
        assert all(r["mix_tokens"] > 0 for r in rows)
    assert stage(clashing.where("doc_id < 0")).count() == 0


def test_op10_judges_an_item_by_its_own_length():
    words = [f"w{i}" for i in range(40)]
    apart = words[:20] + [f"x{i}" for i in range(60)] + words[20:]
    for others in ([], [(2, " ".join(f"long{i}" for i in range(400)))]):
        items = [(1, " ".join(words)), *others]
        frequency = {w: 1 for _, t in items for w in t.split()}
        index = decontam.Index(items, frequency, len(items), 40.0)
        assert index.verified([apart]) == []
        assert [(r[0], r[1], r[3]) for r in index.verified([["y"] * 333 + words + ["z"] * 500, words[:36], words[:30]])] == [(0, 1, 1.0), (1, 1, 32 / 36)]


def test_op9_encodes_rows_that_repeat_once():
    tokenizer = token_cache.Tokenizer(public_tokenizers.path("piece_bpe_32k.model"))
    rows = [(b"a", "a b")] * 5 + [(b"c", "other")] + [(b"d", "")] * 3
    batches = [pa.RecordBatch.from_pydict({"digest": [d for d, _ in part], "text": [t for _, t in part]}) for part in (rows[:2], [], rows[2:6], rows[6:])]
    batches[1] = batches[0].slice(0, 0)
    out = [r for batch in token_cache._encode(tokenizer)(batches) for r in batch.to_pylist()]
    assert [r["digest"] for r in out] == [b"a", b"c", b"d"] and out[2]["n_tokens"] == 0 < out[0]["n_tokens"]
