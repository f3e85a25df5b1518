"""Tokenizer alignment, SimHash linking and vector codes against brute force."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.compare import compare, duck
from tests.conftest import SF
from tests.llm.fixtures import EXTRA, awkward_docs, prose, vocabulary, words
from tillbook.llm import alignment, lloyd, simhash
from tillbook.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def docs(spark):
    return awkward_docs(spark).cache()


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# Tokenizer alignment


def plain_groups(a_ids, a_ends, b_ids, b_ends):
    """Groups by the common ends of both sides, and all overlapping pairs by comparing every range with every other."""
    common = sorted(set(a_ends) & set(b_ends))
    groups, at = [], 0
    for end in common:
        groups.append(
            ([i for i, e in zip(a_ids, a_ends) if at < e <= end], [i for i, e in zip(b_ids, b_ends) if at < e <= end])
        )
        at = end
    starts_a, starts_b = [0, *a_ends[:-1]], [0, *b_ends[:-1]]
    links = [
        (x, y)
        for x, s, e in zip(a_ids, starts_a, a_ends)
        for y, t, f in zip(b_ids, starts_b, b_ends)
        if s < f and t < e
    ]
    return groups, links


def test_probing_finds_the_groups_of_common_ends():
    from types import SimpleNamespace

    rnd = random.Random(2)
    for size in (1, 2, 3, 10, 60, 400, 3000):
        for density in (0.0, 0.001, 0.05, 0.5, 1.0):
            whole = sorted(rnd.sample(range(1, 4 * size + 1), size))
            sides = []
            for _ in range(2):
                ends = [e for e in whole[:-1] if rnd.random() >= density * 0.5]
                sides.append(sorted({*ends, *(rnd.randrange(1, whole[-1] + 1) for _ in range(int(density * size * 0.3))), whole[-1]}))
            a, b = sides
            cut = [[b"x" * (e - s) for s, e in zip([0, *ends], ends)] for ends in sides]
            ids = [list(range(len(ends))) for ends in sides]
            made = SimpleNamespace(
                a=SimpleNamespace(bytes=cut[0]), b=SimpleNamespace(bytes=cut[1]), known={},
                a_noted=[f"{k}|" for k in ids[0]], b_noted=[str(k) for k in ids[1]])
            n, noted, left, right = alignment.aligned(*ids, a, b, made)
            groups, links = plain_groups(ids[0], a, ids[1], b)
            assert n == len(groups) and noted == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
            assert sorted(zip(left, right)) == sorted(links)


def json_vocabulary():
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


def sign_bytes(entry):
    """Bytes of an entry of a byte-level vocabulary: printable signs are bytes, the rest goes from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return bytes(rest[ord(c) - 256] if ord(c) > 255 else ord(c) for c in entry)


def test_ranks_give_the_ids_of_the_json_file():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    rnd = random.Random(9)
    signs = [" ", " ", " ", "  ", "\n", "\t", "'s", "a", "b c", "É", "ß", "1", "23", ".", "-", "_", "\x1c", "\x85", "\xa0", "\u2003", "日", "🙂", "\u0301", "▁", "\x00", "'", "(", "ſ"]
    texts += ["".join(rnd.choice(signs) for _ in range(rnd.randint(1, 40))) for _ in range(3000)]
    want = [e.ids for e in json_vocabulary().encode_batch([" " + t for t in texts], add_special_tokens=False)]
    ranks = alignment.opened(alignment.A_FILE, alignment.B_FILE).a
    assert ranks.encode(texts) == want
    assert all(b"".join(ranks.bytes[k] for k in ids) == (" " + t).encode() for ids, t in zip(want, texts))


def plain_alignment(rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row, with the libraries alone."""
    import public_tokenizers
    import sentencepiece

    a = json_vocabulary()
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    held = []
    for doc_id, text in rows:
        whole = " " + (text or "")
        a_ids, b_ids = a.encode(whole, add_special_tokens=False).ids, b.encode(text or "")
        a_bytes = [sign_bytes(a.id_to_token(i)) for i in a_ids]
        b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
        if not text or not (b"".join(a_bytes) == b"".join(b_bytes) == whole.encode()):
            held.append((doc_id, [], [], [], []))
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes)]
        held.append((doc_id, a_ids, b_ids, *plain_groups(a_ids, ends[0], b_ids, ends[1])))
    n = Counter(pair for h in held for pair in set(h[4]))
    best = defaultdict(int)
    for (x, _), count in n.items():
        best[x] = max(best[x], count)
    out = []
    for doc_id, a_ids, b_ids, groups, links in held:
        noted = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append(
            (
                doc_id, len(a_ids), len(b_ids), len(groups), len(links),
                hashlib.sha256(noted.encode()).hexdigest() if a_ids else "",
                sum(n[p] == best[p[0]] for p in links), sum(n[p] for p in links),
            )
        )
    return sorted(out, key=str)


TRICKY = [
    " ", "  leading", "trailing  ", "a▁b", "▁", "<|endoftext|> <s> </s>", "tab\tand\nline\r\n", "nul\x00byte", "日本語 🙂‍ ñandú",
    "é​﻿", "x" * 700, "<0x41>", "1234567 89,10.11", "ﬁ ½ Å",
]


def test_alignment_is_that_of_all_pairs(spark, docs):
    short = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 5000]
    rows = short + [(5000 + k, t) for k, t in enumerate(TRICKY)] + [(None, "null id"), (5000, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain_alignment(rows)
    assert any(r[1] for r in want) and sum(r[5] == "" for r in want) >= 4
    for heavy in (1 << 18, 50, 1):  # all pairs go to all tasks, some, one
        got = alignment.align_tokenizers(df, heavy=heavy)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
        assert as_rows(got) == want


def test_alignment_of_long_texts_clashing_columns_and_nothing(spark, docs):
    long_text = " ".join(vocabulary()) * 200 + "y" * 50_000
    df = spark.createDataFrame([(1, long_text, 5), (2, "", None)], "doc_id long, text string, pairs int")
    got = {r.doc_id: r for r in alignment.align_tokenizers(df).collect()}
    assert got[1].n_links == got[1].n_a + got[1].n_b - got[1].n_groups > 50_000 and got[2].n_a == 0
    assert alignment.align_tokenizers(docs.limit(0)).count() == 0
    assert alignment.align_tokenizers(docs.withColumnRenamed("node", "row")).count() == docs.count()


# SimHash


def plain_code(text, n):
    import xxhash

    w = words(text)
    shingles = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(codes, radius):
    parent = {c: c for c in codes}

    def find(c):
        while parent[c] != c:
            c = parent[c]
        return c

    distinct = sorted(parent)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[find(b)] = find(a)
    return {c: find(c) for c in distinct}


def test_fingerprints_and_components_are_those_of_all_pairs(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    codes = [plain_code(t, 4) for _, t in rows]
    root = plain_components(codes, 4)
    smallest = defaultdict(list)
    for (doc_id, _), c in zip(rows, codes):
        if doc_id is not None:
            smallest[root[c]].append(doc_id)
    want = [(d, f"{c:016x}", min(smallest[root[c]], default=None)) for (d, _), c in zip(rows, codes)]
    assert as_rows(simhash.near_fingerprints(docs)) == sorted(want, key=str)
    assert set(EXTRA) <= set(docs.columns)
    assert simhash.near_fingerprints(docs.limit(0)).count() == 0


def test_hashes_are_counted_in_blocks(monkeypatch):
    texts = [prose(random.Random(k), 300 * k, vocabulary()).encode() for k in range(4)] + [None, b" \n"]
    want = simhash.majorities(texts, 4)
    monkeypatch.setattr(simhash, "HASHES", 7)
    assert simhash.majorities(texts, 4).tolist() == want.tolist()
    assert [f"{int(x):016x}" for x in want] == [f"{plain_code((t or b'').decode(), 4):016x}" for t in texts]


def test_bytes_beside_letters_and_words(spark):
    texts = ["ÄÖ Äö Z z  x", "A\x0bB\x0cC\rD\tE", "\x1c \x1f \x85", "İI ẞ"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in simhash.near_fingerprints(df).collect()}
    assert got == {k: f"{plain_code(t, 4):016x}" for k, t in enumerate(texts)}


@pytest.mark.parametrize("radius, tree", [(0, 4096), (1, 4096), (4, 4096), (4, 5), (9, 8)])
def test_trees_link_all_pairs_within_the_radius(spark, monkeypatch, radius, tree):
    """Chains and balls of codes around few centres; small trees split every shard."""
    monkeypatch.setattr(simhash, "TREE", tree)
    monkeypatch.setattr(simhash, "OPEN", 64)
    rnd = random.Random(radius)
    codes = {0, 2**64 - 1}
    for _ in range(8):
        code = rnd.getrandbits(64)
        for _ in range(45):
            codes.add(code ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, radius + 1))))
            if rnd.random() < 0.3:
                code = rnd.choice(sorted(codes))
    signed = [(c - 2**64 if c >= 2**63 else c,) for c in codes]
    links = simhash.linked(spark.createDataFrame(signed, "code long"), radius).collect()
    parent = {c: c for c in codes}

    def find(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for r in links:
        a, b = r.a % 2**64, r.b % 2**64
        parent[find(a)] = find(b)
    want = plain_components(codes, radius)
    assert len({(find(c), want[c]) for c in codes}) == len({find(c) for c in codes}) == len(set(want.values()))


def test_searches_follow_only_edges_within_the_radius():
    """A tree is searched whole only where distances allow it, and finds what comparing with all codes finds."""
    rnd = np.random.default_rng(3)
    codes = np.unique(rnd.integers(0, 2**63, 3000).astype(np.uint64))
    near = codes[:50] ^ np.uint64(0b1011)
    for sizes in ([len(codes)], [1, 2, len(codes) - 3]):
        edge, child = simhash.grow(codes, np.array(sizes))
        assert len(edge) == len(codes) - len(sizes) and (np.diff(edge) > 0).all()
        roots = np.repeat(np.cumsum(sizes) - sizes, sizes)
        query, node = simhash.search(near, roots[:50], codes, edge, child, 4)
        want = {
            (q, n) for q in range(50) for n in np.flatnonzero(simhash.distances(codes, near[q]) <= 4) if roots[n] == roots[q]
        }
        assert set(zip(query.tolist(), node.tolist())) == want


# Vector codes


def plain_codes(rows, parts, entries, rounds):
    """(vec_id, code, error, label_error, digest) with plain whole numbers."""
    kept = [(i, [math.floor(256 * c) for c in v], k) for i, v, k in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return []
    size = len(kept[0][1]) // parts
    cut = lambda v: [v[p * size : (p + 1) * size] for p in range(parts)]
    seeds = {}
    for i, v, _ in kept:
        if i is not None:
            seeds[i] = min(seeds.get(i, v), v)
    books = [[cut(seeds[i])[p] for i in sorted(seeds)[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), k) for k, y in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, v, _ in kept:
                members[nearest(cut(v)[p], books[p])[1]].append(cut(v)[p])
            books[p] = [[sum(c) // len(members[k]) for c in zip(*members[k])] if k in members else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    coded = []
    for i, v, label in kept:
        found = [nearest(x, books[p]) for p, x in enumerate(cut(v))]
        coded.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    by_label = Counter()
    for _, _, error, label in coded:
        by_label[label] += error
    return sorted(((i, c, e, by_label[label], digest) for i, c, e, label in coded), key=str)


def vectors(n=300, size=12, seed=4):
    rnd = random.Random(seed)
    centres = [[rnd.uniform(-1, 1) for _ in range(size)] for _ in range(9)]
    rows = [(3 * i, [c + rnd.gauss(0, 0.2) for c in rnd.choice(centres)], rnd.choice([None, 1, 2])) for i in range(n)]
    rows += [rows[5]] * 40 + [(6, rows[9][1], 2)]  # repeated rows, another vector of an id
    rows += [(1, None, 1), (2, [], 1), (4, [None] * size, 1), (5, [math.nan] * size, 1), (7, [math.inf] + [0.0] * (size - 1), None)]
    return rows + [(None, rows[3][1], None), (8000, [0.0] * size, 3), (8001, [900.5] * size, 3), (8002, [-1e-9] * size, 3)]


@pytest.mark.parametrize("parts, entries, rounds, members", [(3, 8, 2, 1 << 18), (4, 64, 3, 10), (12, 5, 1, 10), (1, 256, 2, 50)])
def test_codes_are_those_of_plain_rounds(spark, monkeypatch, parts, entries, rounds, members):
    monkeypatch.setattr(lloyd, "MEMBERS", members)
    rows = vectors()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, position int").repartition(4)
    got = lloyd.compressed(df, parts=parts, entries=entries, rounds=rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert as_rows(got) == plain_codes(rows, parts, entries, rounds)


def test_only_parts_that_change_entry_migrate(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    written = {}
    keep = lloyd.settled
    monkeypatch.setattr(lloyd, "settled", lambda d, name: written.setdefault(name, keep(d, name)))
    lloyd.train(df, parts=3, entries=8, rounds=2)
    moved = written["looked"].filter("moved").count()
    assert 0 < moved < written["residents"].count() and written["arrived"].count() == moved


def test_few_vectors_and_none(spark):
    schema = "vec_id long, embedding array<float>, label int"
    few = [(5, [0.5, 0.25], 1), (3, [0.5, 0.25], 1), (None, [0.1, 0.2], None)]
    assert as_rows(lloyd.compressed(spark.createDataFrame(few, schema), parts=2)) == plain_codes(few, 2, 64, 2)
    empty = lloyd.compressed(spark.createDataFrame([(1, None, 1), (2, [], None)], schema), parts=2)
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(Exception, match="different lengths"):
        lloyd.compressed(spark.createDataFrame([(1, [0.0, 1.0], 1), (2, [0.0], 1)], schema).coalesce(1), parts=2)
    with pytest.raises(ValueError, match="cut into"):
        lloyd.compressed(spark.createDataFrame(few, schema), parts=16)


def test_codes_are_those_of_the_sql(spark):
    ok, note = compare(spark, duck(SF), SF, "op13", QUERIES["op13_vector_codes"], ORACLES["op13_vector_codes"])
    assert ok, note
