"""Packing, conversation repair and ranked search against the libraries and brute force."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from crosswind.llm import packing, queries, ranked, turns
from tests.oracle import check, connect

SF = "/root/testdata/sf0.001"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def real():
    return duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet'").fetchall()


# ---- sum-of-squares packing


def library_ids(texts):
    t = Tokenizer.from_file(WORD_BPE)
    return [[*e.ids, 1] for e in t.encode_batch(texts, add_special_tokens=False)]


def held(rows, capacity):
    """Every sequence is filled without gaps and within the capacity; returns the number of sequences."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by)


ODD = [
    "a 0 b 10 2000 x0y zero00 0",
    "<|endoftext|> x<|startoftext|>y <|endoftext|><|endoftext|>",
    "It's WE'LL i'd 'tis don't  ",
    "ÉCOLE é́ école ΣΑΣ ſ ß 東京タワー  nbsp em \x1c\x1d\x85 x",
    "w" * 300 + " " + "ab" * 40 + " 😀👍🏽 ½ ④",
    " \n\t\x0b\x0c\r ",
    "",
]


def test_words_give_the_ids_of_whole_texts(real):
    with open(WORD_BPE, "rb") as f:
        encode = packing.WordEncoder(f.read())
    texts = ODD + [t for _, t in real]
    got = [np.frombuffer(x, "<u4").tolist() + [1] for x in encode([t.encode() for t in texts])]
    assert got == library_ids(texts)
    long = " ".join(t for _, t in real) * 12
    assert len(long) > 2 * packing.CHUNK_BYTES
    assert np.frombuffer(encode.long(long.encode()), "<u4").tolist() + [1] == library_ids([long])[0]


def test_op11_holds_every_document_once(spark, real):
    rows = queries.op11_sum_of_squares(spark, SF).collect()
    want = {}
    for (doc, _), ids in zip(real, library_ids([t for _, t in real]), strict=True):
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[doc, piece] = (start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    used = sum(r["length"] for r in rows)
    assert held(rows, 4096) <= math.ceil(used / 4096) + 1


def brute_squares(lengths, capacity):
    """The method from its definition: all open bins with room are tried, by the sum over all gaps."""
    gaps, out = [], []
    for size in lengths:
        best = None
        for b, gap in enumerate(gaps):
            if gap >= size:
                total = sum(n * n for g, n in Counter([*gaps[:b], gap - size, *gaps[b + 1 :]]).items() if g)
                best = min(best or (total, gap - size, b), (total, gap - size, b))
        if best is None:
            gaps.append(capacity)
        b = best[2] if best else len(gaps) - 1
        gaps[b] -= size
        out.append(capacity - gaps[b] - size)
    return out, Counter(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_sum_of_squares_follows_its_definition(seed):
    r = random.Random(seed)
    lengths = [r.randint(1, 20) for _ in range(120)]
    found = packing.sum_of_squares(lengths, 20)
    used = Counter()
    for (b, place), size in zip(found, lengths, strict=True):
        assert place == used[b]
        used[b] += size
    places, gaps = brute_squares(lengths, 20)
    assert [p for _, p in found] == places and Counter(20 - x for x in used.values()) == gaps


def test_few_bins_on_hard_lengths():
    r = np.random.default_rng(5)
    for lengths in (r.integers(1, 1000, 3000), r.integers(250, 1000, 3000), np.concatenate([np.full(1000, 370), r.integers(1, 300, 2000)])):
        lengths = -np.sort(-lengths)
        gaps = []
        for size in lengths.tolist():  # best fit decreasing
            fit = min((g for g in gaps if g >= size), default=None)
            if fit is not None:
                gaps.remove(fit)
            gaps.append((1000 if fit is None else fit) - size)
        assert len({b for b, _ in packing.sum_of_squares(lengths.tolist(), 1000)}) <= len(gaps) * 1.005 + 1


def test_pack_in_rounds(spark):
    r = np.random.default_rng(5)
    lengths = np.concatenate([r.integers(1, 100, 3000), np.full(500, 100), np.full(1500, 37)])
    rows = spark.createDataFrame(list(enumerate(lengths.tolist())), "key long, length long").repartition(7)
    got = packing.pack(rows, capacity=100, block=300).collect()
    assert sorted(x["key"] for x in got) == list(range(5000))
    assert held(got, 100) <= 500 + 2271 * 1.01  # best fit decreasing over all: 2271 and the full ones
    # nothing fits anything else: the rounds end, one sequence a piece
    same = spark.range(1000).selectExpr("id as key", "60L as length")
    assert held(packing.pack(same, capacity=100, block=100).collect(), 100) == 1000
    assert packing.pack(rows.where("key < 0"), capacity=100).count() == 0


def test_op11_edges_and_real_sequences(spark):
    docs = [(i, t, 7, 1.0) for i, t in enumerate(ODD)] + [(3, ODD[3], 7, 1.0), (None, "no id", 7, 1.0), (8, None, 7, 1.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, key int, length double")
    packed = packing.pack(packing.pieces(df, WORD_BPE, capacity=50), capacity=50)
    rows = packed.collect()
    want = Counter(map(tuple, library_ids([t or "" for _, t, _, _ in docs])))
    whole = defaultdict(dict)
    for r in sorted(rows, key=lambda r: r["key"]):
        whole[r["key"] - r["piece"]][r["piece"]] = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
    assert Counter(tuple(x for _, part in sorted(p.items()) for x in part) for p in whole.values()) == want
    made = packing.sequences(packed).collect()
    assert len(made) == held(rows, 50) and all(s["length"] == len(s["ids"]) // 4 <= 50 for s in made)
    ids = {s["sequence_id"]: bytes(s["ids"]) for s in made}
    assert all(ids[r["sequence_id"]][r["offset"] * 4 : (r["offset"] + r["length"]) * 4] == bytes(r["ids"]) for r in rows)
    assert packing.pack(packing.pieces(df.where("doc_id = 99"), WORD_BPE)).count() == 0


# ---- conversation repair


def brute_repair(rows):
    """Cheapest (cost, audit) by best-first search over whole edit strings."""
    grammar = re.compile(r"(s?(ua)+)?")
    queue, seen = [(0, "", 0, "")], set()
    while queue:
        cost, audit, at, made = heapq.heappop(queue)
        if (audit, at, made) in seen:
            continue
        seen.add((audit, at, made))
        if at == len(rows) and grammar.fullmatch(made):
            return cost, audit
        steps = [(3, "I", at, made + r) for r in "ua"]
        if at < len(rows):
            initial, fault = rows[at]
            more = 3 * (fault == "truncated")
            steps.append((4, "D", at + 1, made))
            if fault not in ("blank", "duplicate"):
                steps += [(3 + more, "R", at + 1, made + r) for r in "ua"]
                if initial:
                    steps.append((more, "K", at + 1, made + initial))
        for extra, letter, place, roles in steps:
            if re.fullmatch(r"s?(ua)*u?", roles):
                heapq.heappush(queue, (cost + extra, audit + letter, place, roles))
    return None


def test_least_repair_equals_search():
    r = random.Random(1)
    for _ in range(400):
        rows = [(r.choice(["s", "u", "u", "a", "a", " ", "t", ""]), r.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(r.randint(0, 5))]
        assert turns.least_repair(rows) == brute_repair(rows), rows


def test_long_conversations_have_one_cheapest_way():
    rows = [("u", ""), ("a", "")] * 1500
    assert turns.least_repair(rows) == (0, "K" * 3000)
    cost, audit = turns.least_repair([("u", "")] * 301)
    assert cost == 3 * 151 and len(audit.replace("I", "")) == 301


def plain_repair(rows):
    """All of op12's columns for one conversation's damaged rows, in plain Python."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    flags, seen = [], set()
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        flags.append((role[:1], fault))
    turn = [t for t, _, _ in rows if t is not None]
    gaps = max(turn) - min(turn) + 1 - len(set(turn)) if turn else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(flags, flags[1:], strict=False))
    cost, audit = brute_repair(flags)
    lines, queue, n = [], list(rows), 0
    for letter in audit:
        if letter == "I":
            lines.append(("user", "assistant")[n % 2] + ":")
            n += 1
            continue
        _, role, text = queue.pop(0)
        if letter == "D":
            continue
        if letter == "R":
            role = ("user", "assistant")[n % 2]
        n += not (letter == "K" and role[0] == "s")
        lines.append(f"{role}:{text}")
    faults = [f for _, f in flags]
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        fate = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        out[conv] += []
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out[conv] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def test_op12_equals_plain_python_and_sql(spark):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    want = {c: plain_repair(r) for c, r in plain_damage(rows).items()}
    got = queries.op12_big_integer_repair(spark, SF)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    name = "op12_big_integer_repair"
    assert check(spark, connect(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF)[0] == "ok"


def test_op12_edges(spark):
    r = random.Random(4)
    texts = ["Well.", "Well.", "What? ", "no end", "", " \t", None, "é!", "¿", " "]
    rows = [(c, r.choice([None, *range(6)]), r.choice(["system", "user", "assistant", "tool", "", None]), r.choice(texts)) for c in [None, *range(60)] for _ in range(r.randint(1, 5))]
    rows += [(900, 1, "user", "Hi."), (900, 1, "user", "Hi."), (901, 7, "assistant", "x" * 3_000_000)]
    rows += [(c, t, "user", "Gone.") for c in range(1000, 1200) for t in [next(t for t in range(1000) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)]]
    df = spark.createDataFrame([(*x, 5, "x", True) for x in rows], "conv_id long, turn long, role string, text string, place int, time string, there boolean")
    want = {c: plain_repair(x) for c, x in plain_damage(rows).items()}
    got = turns.repairs(turns.damaged(df)).collect()
    assert len(got) == len(want) and {x[0]: tuple(x)[1:] for x in got} == want
    gone = next(x for x in got if x["conv_id"] == 1100)
    assert tuple(gone)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    kept = defaultdict(list)
    for x in turns.repaired_turns(turns.damaged(df)).collect():
        kept[x["conv_id"]].append((x["turn"], f"{x['role']}:{x['text']}"))
    for c, w in want.items():
        own = sorted(kept[c])
        assert [t for t, _ in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(line for _, line in own).encode()).hexdigest() == w[-1]
    nothing = df.where("conv_id = -5")
    assert turns.repairs(turns.damaged(nothing)).count() == 0 and turns.repaired_turns(turns.damaged(nothing)).count() == 0


# ---- ranked search of many queries


def plain_search(docs, items, k=50):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    counted = [(d, Counter(terms(t))) for d, t in docs]
    n, total = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i].update(terms(t))
    out = []
    for i, own in asked.items():
        found = []
        for d, c in counted:
            score, m = 0, 50 + 50 * c.total() * n // max(total, 1)
            for t in own & c.keys():
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, d is not None, d or 0, d))
        out += [(i, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_op13_equals_brute_force_and_sql(spark, real):
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    assert rows_of(queries.op13_shared_term_sets(spark, SF)) == plain_search(real, items)
    name = "op13_shared_term_sets"
    assert check(spark, connect(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF)[0] == "ok"


def test_plan_sums_every_term_once_and_shares():
    r = random.Random(2)
    for run in (2, 8, 32):
        common = list(range(12))
        queries_ = [set(r.sample(common, r.randint(0, 9))) | set(r.sample(range(12, 200), r.randint(0, 6))) for _ in range(60)]
        plan = ranked.Plan(queries_, 200, run)

        def leaves(node, plan=plan):
            return [node] if node < 200 else [t for child in plan.pairs[node - 200] for t in leaves(child)]

        for own, nodes in zip(queries_, plan.queries, strict=True):
            flat = [t for n in nodes for t in leaves(n)]
            assert len(flat) == len(set(flat)) and set(flat) == own
        assert plan.additions() < sum(max(len(q) - 1, 0) for q in queries_)
        assert all(sum(node in q for q in plan.queries) + sum(node in p for p in plan.pairs) >= 1 for node in range(200, 200 + len(plan.pairs)))


def test_op13_edges(spark, real):
    docs = [(d, t) for d, t in real[:60]] + [(3, None), (4, ""), (5, " ,;"), (None, "Zebra ÉTÉ x1 9"), (7, "zebra"), (7, "zebra"), (6, "ZEBRA"), (8, "zebra " * 20_000 + "long")]
    items = [(1, "Zebra!"), (1, "long"), (2, None), (3, ""), (4, "ÉTÉ été"), (5, "zebra"), (5, "zebra"), (None, "x1"), (6, "absent words only"), (7, real[0][1]), (8, real[1][1] + " zebra")]
    a = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n int, term int").repartition(5)
    b = spark.createDataFrame([(*i, 9) for i in items], "item_id long, text string, term int")
    want = plain_search(docs, items)
    assert rows_of(ranked.search(a, b)) == want
    assert rows_of(ranked.search(a, b, postings=40)) == want  # several parts
    assert rows_of(ranked.search(a, b, k=3)) == plain_search(docs, items, 3)
    assert ranked.search(a.where("doc_id = -1"), b).count() == 0 and ranked.search(a, b.where("item_id = -1")).count() == 0


def test_words_that_differ_in_signs_or_case_are_encoded_once(monkeypatch):
    with open(WORD_BPE, "rb") as f:
        encode = packing.WordEncoder(f.read())
    sent, real = [], encode._encoded
    monkeypatch.setattr(encode, "_encoded", lambda texts: sent.extend(texts) or real(texts))
    text = "Gutter gutter, gutter. GUTTER&&& it's It's, dogs' <|endoftext|> gutter<|endoftext|> É, é. x'll! a,b; A,b"
    got = encode([text.encode()])[0]
    assert np.array(encode.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() == got
    assert sum(t.lower().split().count(b"gutter") for t in sent) == 1


def test_words_of_other_letters_part_from_signs_and_plain_words_skip_the_rules(monkeypatch):
    with open(WORD_BPE, "rb") as f:
        encode = packing.WordEncoder(f.read())
    sent, real = [], encode._encoded
    monkeypatch.setattr(encode, "_encoded", lambda texts: sent.extend(texts) or real(texts))
    text = "así, así. así!! Así gutter, it'sé! é× é×, 5é; é<|endoftext|>, ÷÷, á, naïve̸. 0é, straße- " + "é" * 40 + ","
    got = encode([text.encode()])[0]
    assert np.array(encode.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() == got
    assert sum(t.split().count("así".encode()) for t in sent) == 1
    assert b"gutter" in sent  # alone, so that the model gets it without the rules
