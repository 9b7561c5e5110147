"""Small tables with every awkward row, and plain Python versions of what the operators compute."""

import hashlib
import re
import zlib

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def long_text(seed: int, n: int) -> str:
    x, out = seed, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append("".join(chr(97 + (x >> s) % 26) for s in (3, 8, 13, 18))[: 1 + x % 4])
    return " ".join(out)


def awkward() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    base = long_text(7, 120)
    near = base.replace(base.split()[60], "changed", 1)
    return [
        (1, base, "en", "b", 5), (2, base.replace(" ", "  \n", 3), "en", "a", 5), (3, near, "en", None, None), (4, "", "en", "a", 0), (5, None, None, None, None), (6, " \t\n", "de", "b", 3),
        (7, "ein kurzer Satz", "de", "b", 15), (8, "ein kurzer Satz", None, "a", 15), (9, long_text(9, 30_000), "fr", "c", 1), (10, "ABC def", "fr", "c", 7), (10, "ABC def", "fr", "c", 7),
        (None, "ein kurzer Satz", "de", "b", 15), (-4, "x", "", "", 1), (11, "naïve café 東京 \U0001f600", "fr", "é", 9), (12, "12 34 !?", "en", "a", 8), (13, base.upper(), "en", "b", 5),
    ]


def docs(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, DOCS)


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def low(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None, width: int) -> set:
    words = WORD.findall(low(text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def components(texts: dict, width: int, percent: int) -> dict:
    """Smallest id reachable over links, by brute force. texts: text by id."""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in ids}
