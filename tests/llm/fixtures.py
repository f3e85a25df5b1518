"""Small tables with every awkward case, and plain-Python twins of the operators."""

from __future__ import annotations

import random
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
# Names that operators use inside, as columns of the table: they must pass through.
EXTRA = ["node", "score", "found", "M_ID", "chunk", "piece", "label", "rank", "part", "k1"]


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def vocabulary(seed: int = 1, n: int = 400) -> list[str]:
    rnd = random.Random(seed)
    sounds = "ba de fi go ju ka le mi no pa re su ta vo".split()
    return ["".join(rnd.choice(sounds) for _ in range(rnd.randint(2, 4))) for _ in range(n)]


def prose(rnd: random.Random, n: int, vocab: list[str]) -> str:
    return " ".join(rnd.choice(vocab) for _ in range(n))


def awkward_texts() -> list[str | None]:
    """Nulls, empty and blank texts, repeats, near copies, shared passages, very long and very short ones."""
    rnd, vocab = random.Random(7), vocabulary()
    base = [prose(rnd, n, vocab) for n in (1, 3, 4, 5, 6, 7, 40, 120, 300, 300)]
    near = []
    for k in range(40):
        w = base[8].split()
        for _ in range(1 + k % 7):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        near.append(" ".join(w))
    passage = prose(rnd, 80, vocab)
    shared = [f"{prose(rnd, 60, vocab)} {passage} {prose(rnd, 30, vocab)}" for _ in range(12)]
    long_text = prose(rnd, 9000, vocab)
    # Each pair of six and seven shingles or so sits at the edge of what may link.
    edge = [" ".join(vocab[:9]), " ".join(vocab[:10]), " ".join(vocab[:11]), " ".join(vocab[1:10])]
    return (
        [None, None, "", "", " \t\n", "same same same same same same same"]
        + base + near + shared + edge + [long_text, long_text, long_text + " end", base[7], base[7].upper()]
    )


def awkward_docs(spark, repeat_rows: bool = True):
    """doc_id, text, lang, source, n_chars and EXTRA; ids with gaps, repeated rows, a null id, null and tied sources."""
    rows = []
    for i, text in enumerate(awkward_texts()):
        source = None if i % 11 == 0 else "hot" if i % 3 else f"src{i % 4}"
        rows.append((i * 3, text, "en" if i % 2 else None, source, len(text) if text is not None else None))
    if repeat_rows:
        rows += [rows[12], rows[12], rows[20], (None, rows[14][1], None, "src1", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    schema += "".join(f", {c} int" for c in EXTRA)
    return spark.createDataFrame([r + tuple(range(len(EXTRA))) for r in rows], schema).repartition(5)


def shingle_set(text: str | None, n: int) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def near_components(rows: list[tuple[int | None, str | None]], n: int, percent: int) -> list[tuple]:
    """(doc_id, n_shingles, component_id) of every row by all pairs of different sets."""
    sets = [shingle_set(t, n) for _, t in rows]
    distinct = sorted({s for s in sets if s}, key=lambda s: (len(s), sorted(s)))
    parent = {s: s for s in distinct}

    def find(s):
        while parent[s] is not s and parent[s] != s:
            s = parent[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            common = len(a & b)
            if 100 * common >= percent * (len(a) + len(b) - common):
                x, y = find(a), find(b)
                if x != y:
                    parent[x] = y
    smallest = defaultdict(list)
    for (doc_id, _), s in zip(rows, sets):
        if s and doc_id is not None:
            smallest[find(s)].append(doc_id)
    return [
        (d, len(s), d if not s else min(smallest[find(s)], default=None)) for (d, _), s in zip(rows, sets)
    ]
