"""Small tables with every odd case, and plain versions of what the operators compute."""

import random
import re
from collections import Counter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tie string, component_id int, _fp string"
_RNG = random.Random(5)
_VOCABULARY = ["".join(_RNG.choice(["an", "the", "or", "in", "é", "shi", "qua", "lo"]) for _ in range(_RNG.randint(1, 4))) for _ in range(400)]


def prose(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append(rng.choice(_VOCABULARY) + (rng.choice([".", ",", ".\n", "!"]) if rng.random() < 0.15 else ""))
    return " ".join(out)


def documents():
    passage = prose(60, 99)
    texts = {
        1: prose(80, 1), 2: prose(200, 2) + " " + passage, 3: None, 4: "", 5: "  \n\n ", 6: passage + " " + prose(30, 3),
        7: prose(3000, 4), 8: prose(80, 1), 9: prose(80, 1).replace("the", "tha", 1), 10: "x" * 3000, 11: "One word.", 12: "two  words",
        13: "日本語のテキスト。 \u0000   tab\tend", 14: prose(80, 1), 15: "<|endoftext|> don't we're x² ﬁ",
    }
    rows = [(i, t) for i, t in texts.items()] + [(20, prose(40, 7)), (20, prose(40, 8)), (21, prose(50, 9)), (21, prose(50, 9)), (None, prose(80, 1)), (None, None), (None, prose(25, 11))]
    return [(i, t, "en", "s", len(t or ""), "clash", -1, None) for i, t in rows]


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def components(n, links):
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        label[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def repeated(texts, length):
    """Bytes of each text in strings that start twice or more anywhere."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[s:s + length] for r in raws for s in range(len(r) - length + 1))
    out = []
    for r in raws:
        mark = [False] * len(r)
        for s in range(len(r) - length + 1):
            if seen[r[s:s + length]] > 1:
                mark[s:s + length] = [True] * length
        out.append(mark)
    return raws, out


def line_set(line, width):
    line = line.lower()
    return frozenset(line[i:i + width] for i in range(len(line) - width + 1)) or frozenset([line])
