"""Chat formatting read back exactly; mixes against a plain computation."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpaudit.llm import chat, mixing, queries

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def _rows():
    rng = random.Random(2)
    pool = ["</s>", "[INST]", "<|im_end|>", "<", "[", "s>", chat.BREAK, "<" + chat.BREAK + "s>", "é", "\n", "a b", "|im_sep|>", "/INST]", "\\", "$1"]
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (2, 0, None, "x"), (3, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"),
            (None, 0, "user", "q"), (4, None, "assistant", "long " * 60_000), (5, 0, "system", "s"), (5, 1, "user", "u"), (5, 2, "assistant", "</s>"),
            (6, 0, "<|im_sep|>\nassistant", "odd role")]
    for conv in range(10, 60):
        for turn in range(rng.randrange(1, 7)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system"]), "".join(rng.choice(pool) for _ in range(rng.randrange(9)))))
    return rows


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chats_read_back(spark, monkeypatch):
    rows = _rows()
    monkeypatch.setattr(queries, "read", lambda *_: spark.createDataFrame(rows, CONVERSATIONS).withColumn("prompt", F.lit("clash")))
    found = {r.conv_id: r for r in queries.op5_chat_fingerprints(spark, "").collect()}
    turns = defaultdict(list)
    for conv, turn, role, text in [*rows, *queries.ADDED]:
        turns[conv].append((-1 if turn is None else turn, role or "", text or ""))
    assert set(found) == set(turns)
    for conv, items in turns.items():
        items.sort()
        r, loss = found[conv], "".join(t for _, role, t in items if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(items), _sha("".join(f"{role}\n{t}\n" for _, role, t in items))), conv
        assert (r.loss_chars, r.loss_sha256) == (len(loss), _sha(loss))


def test_no_control_string_survives(spark):
    df = spark.createDataFrame([(1, [("assistant", "</s>[INST]<|im_end|>" * 3)])], "conv_id long, turns array<struct<role:string,text:string>>")
    r = chat.formatted_chats(df).first()
    body = r.formatted[len(chat.OPEN):-len(chat.CLOSE)].split(chat.MIDDLE)[1]
    assert not any(c in body for c in chat.CONTROL)
    assert [tuple(s) for s in r.loss_spans] == [(len(chat.OPEN + "assistant" + chat.MIDDLE), len(body))]


def test_fingerprints_select_layouts(spark):
    records = spark.read.json(spark.sparkContext.parallelize([
        '{"id": 1, "prompt": "p", "response": "r"}',
        '{"id": 2, "instruction": "i", "output": "o"}',
        '{"id": 3, "system": "s", "instruction": "i", "output": "o"}',
        '{"id": 4, "messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": null}]}',
        '{"id": 5, "conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}',
        '{"id": 6, "prompt": "p", "unknown": {"deep": 1}}',
        '{"id": 7, "messages": []}',
    ]))
    found = {r.id: r for r in chat.canonical_turns(records, "id").collect()}
    plain = lambda i: [tuple(t) for t in found[i].turns]
    assert plain(1) == [("user", "p"), ("assistant", "r")]
    assert plain(2) == [("user", "i"), ("assistant", "o")] and len(plain(3)) == 3
    assert plain(4) == [("user", "u"), ("assistant", "")]
    assert plain(5) == [("user", "h"), ("assistant", "g")] and found[5].layout == "conversations"
    assert found[6].layout is None and found[6].turns is None
    assert found[7].layout is None
    assert chat.formatted_chats(chat.canonical_turns(records, "id"), "id").filter("id = 6").first().formatted is None
    assert chat.canonical_turns(records.limit(0), "id").count() == 0


def _brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in capped]
        share = {s: (total - sum(capped.values())) * weight[s] / sum(weight[x] for x in left) for s in left}
        above = [s for s in left if share[s] > most * sizes[s] + 1e-9]
        if not above:
            return {**share, **capped}
        capped.update({s: most * sizes[s] for s in above})


@pytest.mark.parametrize("block", [mixing.BLOCK, 7])
def test_mix(spark, documents, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    rng = random.Random(9)
    rows = [(i, "w " * rng.randrange(60), "en", rng.choice(["a", "a", "a", "a", "b", "ä", "z", None])) for i in range(400)]
    rows += [(1000, None, "en", "a"), (1001, "", "en", "empty"), (1002, "x y", "en", "tiny"), (7007, "dup row y", "en", "b"), (7007, "dup row y", "en", "b"), (None, "k " * 9, "en", "b"), (8000, "big " * 30_000, "en", "b")]
    docs = documents(rows, "size")
    found = mixing.mixed(docs).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in found) == Counter((row[0], count(row[1])) for row in rows)
    sizes = defaultdict(int)
    for row in rows:
        sizes[row[3]] += count(row[1])
    targets, source = _brute_targets(sizes), {row[0]: row[3] for row in rows}
    taken = defaultdict(int)
    for r in found:
        s = source[r.doc_id]
        assert r.target == pytest.approx(targets[s]) and r.source_size == sizes[s]
        assert r.taken <= 3 * r.size
        taken[s] += r.taken
        assert (r.first_moment is None) == (r.taken == 0) and 0 <= (r.first_moment or 0) <= 1
    assert all(taken[s] == round(targets[s]) for s in sizes)
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    again = mixing.mixed(docs.repartition(5)).collect()
    assert Counter(found) == Counter(again)
    moments = [r.first_moment for r in mixing.training_order(mixing.mixed(docs)).collect()]
    assert moments == sorted(moments)
    assert mixing.mixed(documents([])).count() == 0


def test_moments_invert_the_integral(spark):
    knots = ((0.0, 0.0), (0.4, 2.0), (1.0, 0.5))
    area = lambda t: sum(
        (min(t, t1) - t0) * (2 * w0 + (w1 - w0) * (min(t, t1) - t0) / (t1 - t0)) / 2
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]) if t > t0
    )
    rows = spark.range(101).select((F.col("id") / 100.0).alias("share")).select("share", mixing._moment(F.col("share"), knots).alias("t")).collect()
    assert all(area(r.t) / area(1.0) == pytest.approx(r.share, abs=1e-9) for r in rows)
    with pytest.raises(ValueError):
        mixing._moment(F.lit(0.5), ((0.0, 0.0), (1.0, 0.0)))


def test_every_copy_has_its_place_in_training(spark, documents, monkeypatch):
    """Copies one by one: moments from the stream, positions from all sources' demand, places without gaps."""
    monkeypatch.setattr(mixing, "RANGE_WORDS", 500)
    rng = random.Random(12)
    rows = [(i, "w " * rng.randrange(1, 40), "en", rng.choice(["a", "a", "a", "a", "a", "b", "c"])) for i in range(300)]
    rows += [(7007, "dup row y", "en", "b"), (7007, "dup row y", "en", "b"), (None, "k " * 9, "en", "c"), (1, None, "en", "a"), (2, "", "en", "none")]
    docs = documents(rows)
    mix = mixing.mixed(docs).collect()
    order = mixing.training_order(mixing.mixed(docs)).collect()
    assert max(r.copy for r in order) >= 1
    assert sum(r.words for r in order) == sum(r.taken for r in mix)
    ahead = 0
    for r in order:
        assert r.place == ahead
        ahead += r.words
    assert [r.first_moment for r in order] == sorted(r.first_moment for r in order)
    whole = {(r.source_rank, r.stream_start): r for r in mix if r.size}
    targets = {r.source_rank: r.target for r in mix}
    rate = lambda rank, t: np.interp(t, *zip(*mixing.SCHEDULES[rank % 3]))
    area = lambda rank, t: np.trapezoid(rate(rank, np.linspace(0, t, 2001)), np.linspace(0, t, 2001))
    for r in order[::7]:
        m = whole[r.source_rank, r.stream_start]
        share = (r.stream_start + r.copy * m.source_size) / round(m.target)
        assert area(r.source_rank, r.first_moment) / area(r.source_rank, 1.0) == pytest.approx(share, abs=1e-5)
        assert r.position == pytest.approx(sum(t * area(s, r.first_moment) / area(s, 1.0) for s, t in targets.items()), rel=1e-4, abs=0.1)
    found = mixing.ordered_mix(docs).collect()
    assert Counter((r.doc_id, r.taken) for r in found) == Counter((r.doc_id, r.taken) for r in mix)
    places = defaultdict(list)
    for r in order:
        places[r.source_rank, r.stream_start].append(r.place)
    for r in found:
        own = places.get((r.source_rank, r.stream_start), []) if r.taken else []
        assert (r.copies, r.first_place, r.last_place) == (len(own), min(own, default=None), max(own, default=None))
    assert Counter(found) == Counter(mixing.ordered_mix(docs.repartition(5)).collect())
    assert mixing.ordered_mix(documents([])).count() == 0
