"""Small corpora and brute-force versions shared by the operator tests."""

import hashlib
import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Texts of every awkward kind: null, empty, spaces only, copies, near copies, shared passages, a long one."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ka", "Le", "mi", "Öz", "tr", "un") for b in ("", "x", "né", "st", "ur", "😀")]
    make = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    texts: list[str | None] = [None, "", "  \t\n", "one", "one two", "ONE two", "a" * 700, "ab" * 400, "a" * 700]
    passage = make(70)
    while len(texts) < n:
        kind = rng.randrange(7)
        if kind == 0:
            texts.append(rng.choice([t for t in texts if t is not None]))
        elif kind == 1:
            base = make(rng.randrange(30, 80)).split(" ")
            texts.append(" ".join(base))
            base[rng.randrange(len(base))] = "changed"
            texts.append(" ".join(base))
        elif kind == 2:
            texts.append(f"{make(rng.randrange(0, 20))} {passage} {make(rng.randrange(0, 20))}")
        elif kind == 3:
            texts.append(make(5) + "\n" + passage[rng.randrange(100) : 300] + make(8))
        else:
            texts.append(make(rng.randrange(1, 120)))
    texts.append(make(3000))
    order = list(range(len(texts)))
    rng.shuffle(order)
    langs, sources = ("en", "de", None), ("src0", "src0", "src1", None)
    return [(3 * i, t, rng.choice(langs), rng.choice(sources), len(t or "")) for i, t in zip(order, texts, strict=True)]


def docs(spark, rows: list[tuple]):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def by_id(df, key: str = "doc_id") -> dict:
    out = {}
    for row in df.collect():
        assert row[key] not in out, row
        out[row[key]] = row
    return out


def words(text: str | None, lower: bool = False) -> list[bytes]:
    raw = (text or "").encode()
    if lower:
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    return WORD.findall(raw)


def shingles(text: str | None, k: int) -> set:
    w = words(text, lower=True)
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_near(rows: list[tuple], k: int) -> dict[int, tuple[int, int]]:
    """doc_id: (set size, smallest id reachable over pairs of similarity 0.8 or more)."""
    sets = {r[0]: shingles(r[1], k) for r in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def brute_bytes(rows: list[tuple], length: int) -> dict[int, tuple]:
    seen: dict[bytes, int] = {}
    raw = {r[0]: (r[1] or "").encode() for r in rows}
    for b in raw.values():
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                gone[j : j + length] = b"\x01" * length
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def brute_passages(rows: list[tuple], width: int) -> dict[int, tuple]:
    seen, out = set(), {}
    for i, text in sorted((r[0], r[1] or "") for r in rows):
        w = words(text)
        gone = [False] * len(w)
        for j in range(len(w) - width + 1):
            key = tuple(w[j : j + width])
            if key in seen:
                gone[j : j + width] = [True] * width
            seen.add(key)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out
