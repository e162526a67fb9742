"""Plain versions of what the operators compute."""

import xxhash

from pitchflow.llm import decontam


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def fingerprint(text):
    tokens = (text or "").encode().lower().split()
    shingles = [b" ".join(tokens[k : k + 3]) for k in range(max(1, len(tokens) - 2))] if tokens else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def shingle_set(text):
    tokens = decontam.WORD.findall((text or "").lower())
    return {tuple(tokens[k : k + 5]) for k in range(max(1, len(tokens) - 4))} if tokens else set()
