"""Operators on single documents, and whole queries, against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import compare, duck
from tests.conftest import SF
from tests.llm.fixtures import EXTRA, awkward_docs, prose, vocabulary, words
from tillbook.llm import common, licenses, mixing, packing, quality, spotsigs, surrogates, tokens, training_order
from tillbook.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def docs(spark):
    return awkward_docs(spark).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def reference_ids(texts):
    """Ids by the other library and file."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_tokens_are_those_of_the_json_vocabulary():
    texts = [None, "", " a  b\n\n", "Straße <|endoftext|> ñandú 12,345", "x" * 5000, "日本 🙂‍", *vocabulary()[:50]]
    assert [a.tolist() for a in tokens.token_arrays(iter(texts))] == reference_ids(texts)


def test_words_of_blocks_are_those_of_the_pattern(spark):
    import pyarrow as pa

    texts = [None, "", " ", "one", "Two  two\x0bTWO", " x y", "ends ", *[f"w{k} " * (k % 7) for k in range(50)]]
    for size in (1, 10, 10_000):
        got = []
        for _, _, data, offsets in common.text_blocks(pa.array(texts), size):
            hashes, starts, _ = common.hashed_words(data, offsets)
            row = np.searchsorted(offsets, starts, "right") - 1
            got += [hashes[row == k].tolist() for k in range(len(offsets) - 1)]
        names = defaultdict(set)
        assert [len(g) for g in got] == [len(words(t)) for t in texts]
        for g, t in zip(got, texts):
            for h, w in zip(g, words(t)):
                names[w].add(h)
        assert all(len(h) == 1 for h in names.values()) and len({min(h) for h in names.values()}) == len(names)


def check_packing(out, rows):
    pieces = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out)
    want = Counter()
    for row, ids in zip(rows, reference_ids([r.text for r in rows])):
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        for k, at in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[at : first if k == 0 else at + 1024]
            want[(row.doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert pieces == want
    by_sequence = defaultdict(list)
    for r in out:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by_sequence), sum(r.length for r in out)


def first_fit(lengths):
    """Bins that the longest-first, first-fit rule needs."""
    room = []
    for length in sorted(lengths, reverse=True):
        for k, left in enumerate(room):
            if left >= length:
                room[k] -= length
                break
        else:
            room.append(1024 - length)
    return len(room)


def test_packing_keeps_every_piece_and_fills(docs, rows):
    for group in (8, 16_384):
        out = packing.pack_documents(docs, group=group).collect()
        sequences, _ = check_packing(out, rows)
        assert sequences <= first_fit([r.length for r in out]) + (0 if group > 8 else 3)


def test_packing_of_nothing(nothing):
    assert packing.pack_documents(nothing).count() == 0


def test_local_search_improves_a_bad_packing():
    rnd = np.random.default_rng(2)
    sizes = rnd.integers(1, 1024, 600)
    bins = np.arange(600)
    found = packing.local_search(sizes, bins, 1024)
    fill = np.bincount(found, sizes)
    assert fill.max() <= 1024 and len(set(found)) <= -(-sizes.sum() // 1024) * 1.05
    assert len(set(packing.local_search(sizes, packing.best_fit(sizes, 1024), 1024))) <= len(set(packing.best_fit(sizes, 1024)))


def test_shards_hold_the_stream(docs, rows, spark, tmp_path):
    layout = training_order.write_shards(docs, f"file://{tmp_path}/s", key=5, length=64, slots_per_shard=40, turns=3)
    out = training_order.read_slots(spark, layout).orderBy("sequence").collect()
    got = np.concatenate([np.frombuffer(r.ids, "<u2") for r in out])
    assert sorted(r.slot for r in out) == list(range(layout.sequences)) and len(got) == layout.tokens
    assert all((r.shard, r.offset) == layout.place(r.slot) and zlib.crc32(r.ids) == r.ids_crc32 for r in out)
    want = Counter(tuple(i) for i in reference_ids([r.text for r in rows]))
    ends, at, found = np.flatnonzero(got == 2), 0, Counter()
    for end in ends.tolist():
        found[tuple(got[at : end + 1].tolist())] += 1
        at = end + 1
    assert found == want
    tail = training_order.read_slots(spark, layout, first=layout.sequences - 3).collect()
    assert sorted(r.slot for r in tail) == list(range(layout.sequences - 3, layout.sequences))


def test_shards_of_nothing(nothing):
    assert training_order.materialise(nothing).count() == 0


def test_permutation_is_one_at_every_size():
    for n in (1, 2, 3, 4, 5, 16, 17, 1000, 65_536, 65_537):
        slots = training_order.permuted(np.arange(n), n, 99)
        assert np.array_equal(np.sort(slots), np.arange(n))
        assert np.array_equal(training_order.permuted(slots, n, 99, back=True), np.arange(n))


def test_mixture_meets_its_targets(docs, rows):
    out = mixing.plan_mix(docs).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(words(r.text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while free:  # share, stop at three times the size, share the rest again
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    taken, largest = Counter(), Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.size * r.copies
        assert (r.position is None) == (r.copies == 0) and (r.position is None or 0 <= r.position <= 1)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in order:
        assert abs(taken[s] - target[s]) <= 2 * largest[s]
    copies = Counter((r.doc_id, r.text_key) for r in out for _ in range(r.copies))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter((r[0], r[1]) for r in mixed.select("doc_id", F.xxhash64("text")).collect()) == copies


def test_schedules_are_inverted(spark):
    df = spark.range(0, 101).select((F.col("id") / 100).alias("y"))
    for tilt in (-0.9, -0.5, 0.0, 0.5, 1.0):
        for r in df.select("y", mixing.training_time(F.col("y"), F.lit(tilt)).alias("t")).collect():
            assert abs((1 - tilt) * r.t + tilt * r.t * r.t - r.y) < 1e-9


def test_mixture_of_nothing_and_of_no_words(spark, nothing):
    assert mixing.plan_mix(nothing).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mixing.plan_mix(blank).collect()] == [(0, 0.0)] * 2


def test_quality_holds_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    scored = QUERIES["op5_quality_classifier"](spark, sf)
    labels = common.table(spark, sf, "labels")
    out = scored.join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in out) >= 0.97 * len(out)
    assert scored.count() == common.table(spark, sf, "documents").count()
    for r in scored.select("doc_id", "held_out").limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_quality_votes_against_plain_cosines(spark, monkeypatch):
    """Against one sorted list of cosines per text: the job, and the blocked votes with three rows and five neighbours."""
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(60)]
    text = lambda few: " ".join(rnd.choice(words[:20] if few else words) for _ in range(rnd.randrange(5, 60)))
    labelled = [(text(k % 3 == 0), int(k % 3 == 0)) for k in range(40)]
    texts = [text(k % 2 == 0) for k in range(30)] + ["", None, " \t", labelled[0][0]]
    known = spark.createDataFrame(labelled, "text string, label int")
    space = quality.fit(known, "text", "label")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in quality.score(docs, known).collect()}
    assert abs(space.prior - sum(y for _, y in labelled) / len(labelled)) < 1e-6
    norm = lambda v: v / max(float(np.sqrt((v * v).sum())), 1e-12)
    raw = [(t or "").encode() for t in texts]
    terms = quality.term_rows(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))

    def voted(row: np.ndarray, k: int) -> float:
        if not row.any():
            return space.prior
        vector = norm(norm(row.astype(np.float64) * space.weights) @ space.projection)
        near = sorted(((float(norm(v.astype(np.float64)) @ vector), float(y)) for v, y in zip(space.vectors, space.labels)), reverse=True)[:k]
        weights = [max(c, 0.0) ** quality.SHARPNESS + 1e-9 for c, _ in near]
        return sum(w * y for w, (_, y) in zip(weights, near)) / sum(weights)

    assert all(abs(got[i] - voted(row, quality.NEIGHBOURS)) < 1e-3 for i, row in enumerate(terms))
    assert any(0.05 < x < 0.95 for x in got.values())
    monkeypatch.setattr(quality, "BLOCK_ROWS", 3)
    monkeypatch.setattr(quality, "NEIGHBOURS", 5)
    assert all(abs(x - voted(row, 5)) < 1e-3 for x, row in zip(quality.votes(space, terms), terms))


def test_quality_is_fitted_outside_the_driver(spark, monkeypatch):
    """The driver neither builds the term matrix nor takes eigenvectors; the order of the rows changes no score."""
    known = spark.createDataFrame([(f"some words of text {k} {k % 7} number", k % 2) for k in range(60)], "text string, label int")
    for name in ("eigh", "norm"):
        monkeypatch.setattr(quality.np.linalg, name, None)
    space = quality.fit(known, "text", "label")
    assert space.prior == 0.5 and space.projection.shape == (quality.TERMS, 60) and space.vectors.shape == (60, 60)
    one, other = (
        {r.text: r.score for r in quality.score(known, rows).collect()}
        for rows in (known.repartition(5), known.orderBy(F.desc("text")).coalesce(1))
    )
    assert len(one) == 60 and all(abs(one[t] - other[t]) < 1e-3 for t in one)


def test_quality_of_awkward_rows(spark, docs, nothing):
    labels = spark.createDataFrame([(15, 1, 0), (18, 0, 0), (18, None, 0), (None, 1, 1), (21, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.score_quality(docs.select("doc_id", "text"), labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert len({r.score for r in out if not words(r.text)}) == 1
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert quality.score_quality(nothing.select("doc_id", "text"), labels).count() == 0
    assert {r.score for r in quality.score_quality(docs.select("doc_id", "text"), labels.limit(0)).collect()} == {0.5}


PRIVATE = [
    "Call +1 (499) 555-6503 or +1-499-555-6503, mail und.34@mail7.example.com or UND.34@MAIL7.EXAMPLE.COM.",
    "Hosts 97.51.17.173 and 97.51.17.173; cards 9807915762804490 4845168114407329 and 1234-5678-9012-3456",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"',
    "Mr. John Smith, Mrs. Anna Smith, Dr Jones, Frau Müller and г-жа Анна Иванова; 123-45-6789; 00:1A:2b:3c:4D:5e",
    "IBAN DE89 3704 0044 0532 0130 00, +49 30 1234567 170.106.47.218",
]
CLEAN = [None, "", "It costs 12.50 on 2020-10-11, version 1.2.3, page 100 of 2500, ratio 3/4.", "Mr and the Dr went on.", "a@b"]


def test_surrogates_replace_all_and_nothing_else(spark):
    df = spark.createDataFrame(list(enumerate(PRIVATE + CLEAN)), "doc_id long, text string").withColumn("found", F.lit(1))
    out = surrogates.replace_entities(df, count="entities").orderBy("doc_id").collect()
    for r, old in zip(out, PRIVATE + CLEAN):
        if old in CLEAN:
            assert (r.text, r.entities) == (old, 0)
            continue
        for secret in ("499", "555", "und.34", "UND.34", "97.51", "9807915762804490", "4845168114407329", "5678", "04dbebab",
                       "9233A8EC", "John", "Smith", "Anna", "Jones", "Müller", "Анна", "Иванова", "45-6789", "1A:2b", "3704",
                       "1234567", "170.106"):
            assert secret not in r.text, (secret, r.text)
    one, two, three = out[0].text, out[1].text, out[2].text
    assert surrogates.replace_entities(df).columns == df.columns
    digits = ["".join(c for c in p if c.isdigit()) for p in one.split(",")[0].split(" or ")]
    assert digits[0] == digits[1] and one.split("mail ")[1].split(" or ")[0] == one.split(" or ")[-1].rstrip(".").lower()
    assert two.split(" and ")[0].split()[-1] == two.split(" and ")[1].split(";")[0]
    assert three.split('"')[1] == three.split('"')[1].lower() and three.split('"')[3] == three.split('"')[3].upper()
    mr, mrs = out[3].text.split(", ")[:2]
    assert mr.split()[-1] == mrs.split()[-1] and mr.split()[1][-1] not in "a" and mrs.split()[1][-1] == "a"


def test_surrogates_stay_distinct_where_they_collide(spark):
    """Far more names than there are short surrogates: later attempts must keep them apart, and away from real names."""
    rnd = random.Random(4)
    names = sorted({"".join(rnd.choice("aeioubdfg") for _ in range(6)).capitalize() for _ in range(3000)})
    df = spark.createDataFrame([(k, f"Mr {n} Smith and Mr {n}") for k, n in enumerate(names)], "doc_id long, text string")
    out = surrogates.replace_entities(df).collect()
    given = [r.text.split()[1] for r in out]
    family = [r.text.split()[-1] for r in out]
    assert len(set(given)) == len(names) and len(set(family)) == len(names)
    assert not set(given) & set(names)
    assert surrogates.settle(surrogates.distinct_entities(df)).filter("attempt > 0").count() > 0


def test_surrogates_of_a_full_range_grow_longer(spark):
    """All thousand numbers of five digits that begin with +25: no surrogate of that length is free."""
    df = spark.createDataFrame([(k, f"+25{k:03d}") for k in range(1000)], "doc_id long, text string")
    old, new = zip(*[(r.doc_id, r.text) for r in surrogates.replace_entities(df).collect()])
    assert len(set(new)) == 1000 and all(t.startswith("+25") and t[1:].isdigit() and len(t) > 6 for t in new)


def test_surrogates_of_planted_entities(spark):
    """Between words that stay: one surrogate per entity in all texts, none shared, none real, each of its own format."""
    rnd = random.Random(11)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    make = {  # formats without groups of their own
        r"[^@ ]+@[^@ ]+\.[a-z]{2,}": lambda: f"{''.join(rnd.choice('abcdef') for _ in range(5))}.{digits(2)}@host{digits(2)}.org",
        r"\d{1,3}(?:\.\d{1,3}){3}": lambda: ".".join(str(rnd.randrange(1, 255)) for _ in range(4)),
        r"\d{3}-\d{2}-\d{4}": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        r"\(\d{3}\) \d{3}-\d{4}": lambda: f"({rnd.randrange(200, 999)}) {rnd.randrange(200, 999)}-{digits(4)}",
        r"[0-9a-f]{2}(?::[0-9a-f]{2}){5}": lambda: ":".join(f"{rnd.randrange(256):02x}" for _ in range(6)),
    }
    pool = [(shape, new()) for shape, new in make.items() for _ in range(60)]
    kind = {e: shape for shape, e in pool}
    fill = ["of the", "then came", "a plain list,", "so it goes", "und weiter", "\u90fd\u5e02", "\n"]
    planted = []
    for _ in range(400):
        picked = [rnd.choice(pool)[1] for _ in range(rnd.randrange(5))]
        planted.append((picked, [rnd.choice(fill) for _ in range(len(picked) + 1)]))
    texts = [f[0] + "".join(f" {e} {g}" for e, g in zip(picked, f[1:])) for picked, f in planted]
    out = surrogates.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), count="n").orderBy("doc_id").collect()
    given: dict[str, str] = {}
    for r, (picked, f) in zip(out, planted, strict=True):
        found = re.fullmatch(re.escape(f[0]) + "".join(f" ({kind[e]}) {re.escape(g)}" for e, g in zip(picked, f[1:])), r.text)
        assert found and r.n == len(picked), (r.text, picked)
        for e, new in zip(picked, found.groups()):
            assert given.setdefault(e, new) == new
    assert len(set(given.values())) == len(given) and not set(given.values()) & set(kind)


def test_surrogates_of_whole_names_and_of_later_mentions(spark):
    texts = [
        "Dr Anna Maria Schmidt, Mr John F. Kennedy, Herr Dr. Ludwig van Beethoven, Mr J. R. R. Tolkien and Ms O'Brien.",
        "Smith knew. Mr John Smith came; John Smith's dog and Smith left. Smithson stayed.",
        "At 2001:db8::1, fe80::1ff:fe23:4567:890a and not std::abs, x[1::2] or ::1.",
        "aa:bb:cc:dd:ee:ff",
        "abcd:abcd:abcd:abcd:abcd:abcd:abcd:abcd",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = surrogates.replace_entities(df, count="entities").orderBy("doc_id").collect()
    for name in "Anna Maria Schmidt John Kennedy Ludwig Beethoven Tolkien O'Brien Brien".split():
        assert name not in out[0].text, (name, out[0].text)
    assert " van " in out[0].text and out[0].entities == 5
    first, second = out[1].text.split(" came; ")[0].split()[-2:]
    assert out[1].text == f"{second} knew. Mr {first} {second} came; {first} {second}'s dog and {second} left. Smithson stayed."
    assert out[1].entities == 5 and first != "John" and second != "Smith"
    assert "2001:db8" not in out[2].text and "fe80" not in out[2].text
    assert out[2].text.endswith(" and not std::abs, x[1::2] or ::1.") and "::" in out[2].text.split(",")[0]
    for r, old in zip(out[3:], texts[3:]):
        assert r.entities == 1 and r.text != old and len(r.text) == len(old)


def test_surrogates_of_very_long_runs(spark):
    """A hundred thousand names, labels, titles, digits, initials and signs in a row end no task."""
    n = 100_000
    runs = [
        "Mr " + "Smith " * n, "Mr " + " ".join(f"Name{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(n)), "x@" + "ab." * n + "com",
        "a." * n + "b@c.org", "Mr " * n, "Dr Dr Prof " * (n // 3) + "Jones", "1" * n, "12 " * n, "+25 " + "123 " * n, "Mr " + "J. " * n + "Kennedy",
        "ab:" * n, "::" * n, "DE89 " + "3704 " * n, "Mr von " + "van " * n + "Beethoven", "-" * n + "1-2-3", "O'" * n,
    ]
    df = spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string").repartition(8)
    out = {r.doc_id: r.text for r in surrogates.replace_entities(df, count="entities").collect()}
    assert len(out) == len(runs) and all(len(out[k]) > len(runs[k]) // 4 for k in out)
    assert not out[0].startswith("Mr Smith") and "Kennedy" not in out[9][:10]
    assert set(out[6]) <= set("0123456789ABCDEF") and out[15] == runs[15]


def test_a_person_keeps_one_name_under_all_titles(spark):
    texts = ["Mr John Smith met Dr John Smith. JOHN SMITH left with Mrs Anna Smith, and Dr Anna Smith.", "Dr John Lee", "Dr Γιάννης Παπαδόπουλος"]
    out = [r.text for r in surrogates.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    w = out[0].replace(".", "").replace(",", "").split()
    assert w[1:3] == w[5:7] and [x.lower() for x in w[7:9]] == [x.lower() for x in w[1:3]] and w[7].isupper()
    assert w[12:14] == w[16:18] and w[13] == w[2] and w[12].endswith("a")
    assert out[1].split()[1][:6] == w[1][:6]  # the same sounds, a neutral ending
    assert all("\u0370" <= c <= "\u03ff" for c in out[2].split(" ", 1)[1].replace(" ", "")) and "Παπαδόπουλος" not in out[2]


def test_licenses_count_units_once(spark):
    line = next(iter(licenses.TEMPLATES.values()))
    df = spark.createDataFrame([(1, line, 3), (1, line, 4), (2, line + "\n" + line + " x", 5), (3, "word " * 200_000, 6)], "doc_id long, text string, unit int")
    assert {(r.doc_id, r.units) for r in licenses.find_licenses(df).collect() if r.dice == 1.0} == {(1, 1), (2, 3)}  # the whole text, too


@pytest.mark.parametrize("chunk_rows, stride, bounds, sent", [(2, 3, 65536, 1 << 20), (2, 3, 4, 0), (1, 2, 1, 5), (5, 256, 65536, 0), (4096, 256, 65536, 1 << 20)])
def test_next_rows_of_hot_and_null_ids(spark, monkeypatch, chunk_rows, stride, bounds, sent):
    """A third of the rows under one id, another without any, and many chunks: every row is followed by the next one.

    With few bounds the chunks come from ranges between them, and with none sent, first rows from a shuffled join.
    """
    monkeypatch.setattr(spotsigs, "BOUNDS", bounds)
    monkeypatch.setattr(spotsigs, "SENT_CHUNKS", sent)
    monkeypatch.setattr(spotsigs, "CHUNK_ROWS", chunk_rows)
    monkeypatch.setattr(spotsigs, "STRIDE", stride)
    rows = [(7, f"t{k}") for k in range(40)] + [(None, f"n{k}") for k in range(40)] + [(k * k - 30, f"u{k}") for k in range(40)] + [(2**62 + k, f"b{k}") for k in range(9)] + [(7, "t3"), (None, "n5"), (7, "t3")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("tie", F.xxhash64("text"))
    out = spotsigs.with_next(df, "doc_id", ["text", "big"], "tie", {"big": F.upper("text")}).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows) and all(r.big == r.text.upper() for r in out)
    ordered = sorted(out, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.tie))
    places = Counter((a.text, b.text) for a, b in zip(ordered, ordered[1:] + ordered[:1]))
    assert Counter((r.text, r.next_text) for r in out) == places and all(r.next_big == r.next_text.upper() for r in out)


def test_surrogates_of_nothing(nothing):
    assert surrogates.replace_entities(nothing).columns == nothing.columns and surrogates.replace_entities(nothing).count() == 0


@pytest.mark.parametrize("chunk_rows", [7, 2048])
def test_fingerprints_of_edited_texts(docs, rows, monkeypatch, chunk_rows):
    monkeypatch.setattr(spotsigs, "CHUNK_ROWS", chunk_rows)
    out = spotsigs.edit_check(docs.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    texts = {r.doc_id: r.text or "" for r in rows if r.doc_id is not None}
    ids = sorted(texts)
    assert sorted(r.doc_id for r in out) == ids
    after = dict(zip(ids, ids[1:] + ids[:1]))
    prints = defaultdict(set)
    for r in out:
        text, following = texts[r.doc_id], texts[after[r.doc_id]]
        edited = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints[text].add(r.fingerprint)
        prints[edited].add(r.edited_fingerprint)
        if edited == text:
            assert r.near_edited == 1.0
    assert all(len(p) == 1 for p in prints.values())
    by_text = {r.doc_id: {r.fingerprint[k : k + 16] for k in range(0, len(r.fingerprint), 16)} for r in out}
    for r in out:
        a, b = by_text[r.doc_id], by_text[after[r.doc_id]]
        assert abs(r.near_next - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12


def test_fingerprints_of_repeated_and_null_ids_and_of_nothing(docs, nothing, spark):
    assert spotsigs.edit_check(docs).count() == docs.count()
    assert spotsigs.edit_check(nothing).count() == 0
    alone = spotsigs.edit_check(spark.createDataFrame([(1, "the old house by the sea")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0


@pytest.mark.parametrize("similarity", [0.8, 0.5])
def test_classes_of_fingerprints_are_those_of_all_pairs(docs, similarity):
    got = sorted((tuple(r) for r in spotsigs.near_duplicates(docs, similarity).collect()), key=str)
    held = docs.select("doc_id", spotsigs.signatures(F.col("text")).alias("signs")).collect()
    sets = sorted({frozenset(r.signs) for r in held if r.signs}, key=sorted)
    group = {s: s for s in sets}
    for i, a in enumerate(sets):
        for b in sets[i + 1 :]:
            if len(a & b) >= similarity * len(a | b) - 1e-9 and group[a] != group[b]:
                old, new = group[b], group[a]
                group = {s: new if g == old else g for s, g in group.items()}
    least = defaultdict(list)
    for r in held:
        if r.signs and r.doc_id is not None:
            least[group[frozenset(r.signs)]].append(r.doc_id)
    want = [(r.doc_id, min(least[group[frozenset(r.signs)]]) if r.signs else r.doc_id) for r in held]
    assert got == sorted(want, key=str)


def test_chains_follow_anchors(spark):
    df = spark.createDataFrame([("The Old, of the house!",), ("old the house garden",), ("!!!",), ("",), (None,)], "t string")
    signs = [r[0] for r in df.select(spotsigs.signatures(F.col("t"))).collect()]
    expected = df.sparkSession.range(1).select(
        F.xxhash64(F.lit("^"), F.lit(""), F.lit("")).alias("a"), F.xxhash64(F.lit("the"), F.lit("house"), F.lit("garden")).alias("b")
    ).first()
    assert len(signs[0]) == 1 and expected.b in signs[1] and len(signs[1]) == 2 and len(signs[2]) == 1
    assert signs[3] == [] and signs[4] == []


def test_texts_without_anchors_count_as_a_whole(spark):
    """Texts of no common word: all of it is in the fingerprint, and an edit of a quarter leaves most of it."""
    w = vocabulary()
    base = w[:2] + w[10:50]
    texts = [w[:2] + w[60:100], base, base[:32] + w[200:210], w[:3], w[:2] + w[5:6], base[:32] + ["the", *w[200:204], "of", *w[204:208]]]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "k int, t string")
    signs = [set(r[0]) for r in df.orderBy("k").select(spotsigs.signatures(F.col("t"))).collect()]
    like = lambda a, b: len(a & b) / len(a | b)
    assert like(signs[0], signs[1]) < 0.1 and like(signs[1], signs[2]) > 0.5 and like(signs[1], signs[5]) > 0.5
    assert signs[3] != signs[4] and len(signs[1]) >= 40


def test_licenses_by_dice(spark, nothing):
    mit = licenses.TEMPLATES["MIT"]
    half = " ".join(mit.split()[: len(mit.split()) // 2])
    texts = [
        (1, "prose here\nReleased under the MIT License.\nmore prose"), (2, f"before it\n\n{mit}\n\nafter it"), (3, half),
        (4, mit.replace(" ", "\n")), (5, None), (6, ""), (7, "word"), (8, "Licensed under the Apache License Version 2.0"),
        (1, "Released under the MIT License!"), (None, "Licensed under CC BY-NC 4.0."),
    ]
    out = {(r.doc_id, r.license): r.dice for r in licenses.find_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert out == {(1, "MIT-line"): 1.0, (2, "MIT"): 1.0, (4, "MIT"): 1.0, (8, "Apache-2.0-line"): 1.0, (None, "CC-BY-NC-4.0-line"): 1.0}
    assert licenses.find_licenses(nothing).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    ok, note = compare(spark, duck(SF), SF, name, QUERIES[name], ORACLES[name])
    assert ok, note


def test_packing_query_keeps_every_document(spark):
    rows = common.table(spark, SF, "documents").select("doc_id", "text").collect()
    sequences, total = check_packing(QUERIES["op4_best_fit_packing"](spark, SF).collect(), rows)
    assert sequences <= -(-total // 1024) * 1.02 + 1


def test_surrogate_query_leaves_clean_documents_alone(spark):
    old = {r.doc_id: r.text for r in common.table(spark, SF, "documents").collect()}
    for r in QUERIES["op6_pii_surrogates"](spark, SF).collect():
        assert r.entities > 0 or r.text == old[r.doc_id]
        if r.entities:
            for word in old[r.doc_id].split():
                if "@" in word or (sum(c.isdigit() for c in word) >= 10 and len(word) >= 16):
                    assert word.strip("\"'.,;!$%&#*") not in r.text


def test_names_of_columns_do_not_clash(docs):
    assert set(EXTRA) < set(docs.columns)
    free = common.unused(docs, "chunk", "m_id", "fresh")
    assert free == {"chunk": "_chunk", "m_id": "_m_id", "fresh": "fresh"}
