"""Token counts, packing, mixing and subjects."""

import os
import random
from collections import defaultdict

import numpy as np
import pytest

from lipika.llm import mixing, packing, subjects, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.DEFAULT), reason="no tokenizer files")
DOCS = "doc_id long, text string, lang string, source string, kind string"


def rows(n=300, seed=3):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        source = rng.choice(["big"] * 6 + ["Small", "tiny_one", None])
        out.append((k, " ".join(rng.choice(["river", "stone", "lantern", "गली", "ಕನ್ನಡ", "x = 1;"]) for _ in range(rng.randint(0, 120))), rng.choice(["en", "EN", "eng", "en-IN", "hin", None]), source, rng.choice(["prose_en", "prose_en_held", None])))
    return out + [(9001, None, "en", "big", None), (9002, "", "en", "big", None), (9003, "word " * 30_000, "en", "big", None), (9003, "again the same id", "en", "big", None), (None, "no id", "en", "big", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).selectExpr("*", "7 as tokens", "'z' as container", "timestamp'2024-01-01' as loaded_at")


def sizes():
    count = tokens.encoder(tokens.DEFAULT)
    return [(r[0], count([r[1]])[0] if r[1] else 0, r[3]) for r in rows()]


def test_token_budget(spark, docs):
    entries = spark.createDataFrame([("big", "LATIN"), ("tiny-one", None)], "name string, slot string")
    counted = tokens.document_tokens(docs, entries, "source")
    got = {r["doc_id"]: r for r in counted.collect()}
    want = {d: n for d, n, _ in reversed(sizes()) if d is not None and d != 9003}
    assert {d: got[d]["tokens"] for d in want} == want and len(got) == len(want) + 1
    assert {r["lang"] for r in got.values()} == {"en", "hi", None} and {r["kind"] for r in got.values()} == {"prose_en", None}
    cube = tokens.token_budget(counted).collect()
    total = [r for r in cube if r["level"] == 15]
    assert len(total) == 1 and total[0]["tokens"] == sum(r["tokens"] for r in got.values()) and total[0]["documents"] == len(got)
    by_entry = {r["entry"]: r["tokens"] for r in cube if r["level"] == 7}
    assert sum(by_entry.values()) == total[0]["tokens"] and "tiny-one" in by_entry
    assert tokens.token_budget(tokens.document_tokens(docs.limit(0), entries, "source")).where("documents > 0").count() == 0


def test_best_fill_is_optimal():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        room = rng.randint(1, 90)
        sums = {0}
        for length, n in counts.items():
            sums |= {s + length * k for s in sums for k in range(n + 1)}
        got = packing.best_fill(room, sorted(counts, reverse=True), counts)
        assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[k] for k, n in got.items())


def test_pack_keeps_items_whole():
    rng = np.random.default_rng(4)
    items = rng.integers(0, 257, 3000)
    boxes = packing.pack(items, 256)
    used = np.bincount(boxes, items)
    assert used.max() <= 256 and items.sum() / (len(used) * 256) > 0.98
    assert packing.pack(np.zeros(0, int), 10).tolist() == [] and packing.pack(np.array([0, 0]), 10).tolist() == [0, 0]


def test_placements(spark, docs):
    packs = spark.createDataFrame([("s", 64), ("m", 1000), ("bad", 0), (None, 5), ("null", None)], "pack_name string, capacity_tokens int")
    found = packing.placements(docs, packs, window=50).collect()
    for name, capacity in (("s", 64), ("m", 1000)):
        own = [r for r in found if r["pack_name"] == name]
        per, boxes = defaultdict(list), defaultdict(int)
        for r in own:
            per[r["doc_id"]].append(r)
            boxes[r["container"]] += r["tokens"]
        assert max(boxes.values()) <= capacity
        want = defaultdict(list)
        for d, n, _ in sizes():
            if d is not None:
                want[d].append(n)
        assert {d: sum(r["tokens"] for r in v) for d, v in per.items()} == {d: sum(v) for d, v in want.items()}
        assert all(len(per[d]) == 1 for d, v in want.items() if len(v) == 1 and v[0] <= capacity)
    assert {r["pack_name"] for r in found} == {"s", "m"}
    assert packing.placements(docs.limit(0), packs).count() == 0
    report = packing.fill(packing.placements(docs, packs)).collect()
    assert all(r["fill"] > 0.9 and r["containers"] >= r["least_containers"] for r in report)


def test_mix(spark, docs):
    targets = spark.createDataFrame([("m", "BIG", 0.5, 1), ("m", "small", 0.3, 4), ("m", "tiny-one", 0.2, 3), ("m", "absent", 0.1, 3), ("n", "big", 0.4, 2), ("n", None, 0.1, 1), ("n", "small", None, 1)], "mix_name string, source string, target_share double, max_repeats int")
    chosen, shares = mixing.mixed(docs, targets)
    rows_ = shares.collect()
    for r in rows_:
        assert r["most_repeats"] <= r["max_repeats"]
        assert r["available"] == 0 or abs(r["tokens"] - r["budget"]) <= 30_000 if r["source"] == "big" else abs(r["tokens"] - r["budget"]) <= 400 * max(r["most_repeats"], 1)
    assert {(r["mix_name"], r["source"]) for r in rows_} == {("m", "big"), ("m", "small"), ("m", "tiny-one"), ("m", "absent"), ("n", "big")}
    for mix in "mn":
        assert abs(sum(r["share"] for r in rows_ if r["mix_name"] == mix) - 1) < 1e-9
    again = {tuple(r) for r in mixing.mixed(docs.repartition(7), targets)[0].collect()}
    assert again == {tuple(r) for r in chosen.collect()}  # whatever the partitioning
    assert mixing.mixed(docs.limit(0), targets)[0].count() == 0


def test_places_are_prefix_sums(docs):
    by = defaultdict(list)
    for r in mixing.places(docs).collect():
        by[r["source"]].append(r)
    for own in by.values():
        total = 0
        for r in sorted(own, key=lambda r: r["until"]):
            total += r["tokens"]
            assert r["until"] == total


def test_a_total_is_met_or_all_there_is(spark, docs):
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "small", 0.5, 2)], "mix_name string, source string, target_share double, max_repeats int")
    half = {r["source"]: r for r in mixing.mixed(docs, targets, total=4000)[1].collect()}
    assert all(abs(r["budget"] - 2000) <= 1 or r["budget"] == r["available"] * r["max_repeats"] for r in half.values())
    much = mixing.mixed(docs, targets, total=10**9)[1].collect()
    assert all(r["tokens"] == r["budget"] == r["available"] * r["max_repeats"] and r["most_repeats"] == r["max_repeats"] for r in much)


def test_ranges_of_the_key_are_its_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 10)
    frame = spark.createDataFrame([(k, "one two three " * (k % 5 + 1), "s") for k in range(300)], "doc_id long, text string, source string")
    placed = mixing.places(frame).selectExpr("doc_id", "until", f"xxhash64(doc_id, {mixing.SEED}) as key").collect()
    assert [r["doc_id"] for r in sorted(placed, key=lambda r: r["until"])] == [r["doc_id"] for r in sorted(placed, key=lambda r: r["key"] % (1 << 64))]


def test_too_many_kinds_are_an_error(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "PACKS", 2)
    packs = spark.createDataFrame([(f"p{k}", 100 + k) for k in range(3)], "pack_name string, capacity_tokens int")
    with pytest.raises(ValueError):
        packing.placements(docs, packs)


BANK = {"law": "jury verdict appeal statute tribunal plaintiff".split(), "music": "violin chorus octave melody drummer sonata".split(), "sport": "wicket goalkeeper referee sprint medal stadium".split()}
PLAIN = "The blanket was damp and Hestmor walked home.|Every neighbour in Yorklo has a calendar to show.".split("|")


def subject_rows(n, seed):
    rng = random.Random(seed)
    docs, truth = [], {}
    for k in range(n):
        own = rng.sample(sorted(BANK), rng.choice([0, 1, 1, 2]))
        parts = [f"After the {rng.choice(BANK[s])} came the {rng.choice(BANK[s])} of Vlim{k}." for s in own for _ in range(4)] + [rng.choice(PLAIN) for _ in range(3)]
        rng.shuffle(parts)
        docs.append((k, " ".join(parts), "src"))
        truth[k] = set(own)
    return docs, truth


def test_subjects_on_held_out_documents(spark):
    docs, truth = subject_rows(400, 8)
    rng = random.Random(1)
    labels = [(d, s.upper() if rng.random() < 0.1 else s) for d in range(150) for s in (truth[d] or {"none"}) if rng.random() > 0.05] + [(d, "law") for d in range(0, 150, 37)] + [(3, None), (None, "law"), (3, "unheard of")]
    code = [(1000, "def f(x):\n    return x + 1\nimport os\nx = f(3);", None), (1001, "Let us see.\n$x^2 + 1$\n\\[ a = b \\]", None), (1002, None, None), (1003, "  ", "src"), (1004, "One passing verdict. " + " ".join(PLAIN * 5), "src")]
    frame = spark.createDataFrame(docs + code, "doc_id long, text string, source string").selectExpr("*", "'q' as labels", "1 as pattern")
    areas = spark.createDataFrame([(k, s) for k, s in enumerate([*BANK, "software", "mathematics", None])], "subject_id int, subject string")
    said = spark.createDataFrame(labels, "doc_id long, subject string")
    got = defaultdict(set)
    for r in subjects.document_subjects(frame, said, areas).collect():
        got[r["doc_id"]].add(r["subject"])
    held = range(150, 400)
    right = sum(len(got[d] & truth[d]) for d in held)
    assert right >= 0.97 * sum(len(truth[d]) for d in held) and right >= 0.97 * sum(len(got[d]) for d in held)
    assert got[1000] == {"software"} and got[1001] == {"mathematics"} and not got[1002] and not got[1004]
    assert subjects.document_subjects(frame.limit(0), said, areas).count() == 0
    assert subjects.document_subjects(frame, said.limit(0), areas).where("subject in ('law', 'music')").count() == 0
    assert subjects.composition(frame, said, areas).where("subject = 'law'").first()["documents"] > 50
