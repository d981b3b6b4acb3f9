"""Small fixtures and brute-force counterparts."""

import hashlib
import random
import re

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
VOCABULARY = ["alpha", "Beta", "gamma,", "delta", "epsilon.", "zeta", "é", "éta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "x1", "rho", "sigma", "tau", "phi"]


def prose(r: random.Random, n: int) -> str:
    return "".join(r.choice(VOCABULARY) + r.choice((" ", " ", " ", "\n", "  ")) for _ in range(n)).strip()


def corpus(seed: int, docs: int, longest: int = 120) -> list[tuple[int, str]]:
    """Random texts with exact copies, near copies and shared passages."""
    r = random.Random(seed)
    passage = prose(r, 45)
    out: list[tuple[int, str]] = []
    for i in range(docs):
        kind = r.random()
        if out and kind < 0.15:
            text = r.choice(out)[1]
        elif out and kind < 0.35:
            words = r.choice(out)[1].split(" ")
            for _ in range(max(1, len(words) // 40)):
                words[r.randrange(len(words))] = r.choice(VOCABULARY) + str(r.randrange(99))
            text = " ".join(words)
        else:
            text = prose(r, r.randint(0, longest))
            if kind > 0.8:
                text += " " + passage
        out.append((i, text))
    return out


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def components(links, nodes):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}
