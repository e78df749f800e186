"""Small tables of hard rows, and brute-force versions of what operators compute."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
_SYLLABLES = "an er st on ti ea th ou le de qu vi pa ma so re".split()


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(seed: int, n: int) -> str:
    rng, out = random.Random(seed), []
    for k, w in enumerate(words(rng, n)):
        out.append(w.capitalize() if k % 9 == 0 else w)
        out.append(".\n" if k % 27 == 26 else " ")
    return "".join(out).strip()


def edited(text: str, seed: int, n: int) -> str:
    rng, parts = random.Random(seed), text.split(" ")
    for _ in range(n):
        parts[rng.randrange(len(parts))] = "zz" + words(rng, 1)[0]
    return " ".join(parts)


def hard_documents() -> list[tuple]:
    """Nulls, empties, blanks, copies, near copies, shared passages, repeated ids and rows, a
    long text, ties, a hot source."""
    base = [prose(s, 60 + 7 * s) for s in range(12)]
    passage = prose(99, 50)
    rows = [(k, t, "en", f"s{k % 3}") for k, t in enumerate(base)]
    rows += [(20 + k, base[0], "en", "hot") for k in range(5)]
    rows += [(40 + k, edited(base[3], k, 1 + k % 3), "en", "hot") for k in range(8)]
    rows += [(60 + k, f"{prose(200 + k, 30)} {passage} {prose(300 + k, 20)}", "fr", "hot") for k in range(4)]
    rows += [(70, None, None, None), (71, "", "en", ""), (72, " \t\n\x0b", "en", None), (73, "one", "en", "é"), (74, "One", "en", "é"), (75, "a b c", "de", "hot"), (76, "A  b\nc", "de", "hot")]
    rows += [(80, prose(7, 6000), "en", "hot"), (81, "spam " * 400, "en", "hot"), (82, f"{passage} {passage}", "en", "s0"), (83, "naïve É ß İstanbul 日本語 <|endoftext|> it's", "fr", "s1")]
    rows += [(None, base[5], "en", "s1"), (None, None, None, None), (None, prose(55, 50), "en", "s2")]
    rows += [(2, base[2], "en", "s2"), (2, base[2], "en", "s2"), (2, prose(66, 80), "en", "s0")]
    rows += [(90, "HELLO THERE!! WORLD!! " * 12, "en", "s0"), (91, "x*** y### z$$$ " * 20, "en", "s0"), (92, "Same line here\nsame LINE here \nother line of it\nSame line here", "en", "s1"), (93, "same line here\nlast one line", "en", "s1")]
    return [(d, t, lang, s, len(t) if t is not None else None) for d, t, lang, s in rows]


def frame(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def shingle_set(text: str | None, width: int = 5) -> frozenset:
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def components(rows, num: int, den: int, width: int = 5) -> list:
    """Least doc_id of each row's component, by comparing all pairs."""
    sets = [shingle_set(r[1], width) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((min(ids) if ids else None) if sets[i] else rows[i][0])
    return out


def ordered(rows) -> list:
    return sorted(rows, key=repr)
