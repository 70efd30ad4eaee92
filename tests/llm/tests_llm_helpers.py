"""Plain versions that several tests use."""

import re

KEYWORD = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_secrets(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def ids_of(name, texts, end):
    from tokenizers import Tokenizer

    from querent.llm import queries

    t = Tokenizer.from_file(queries.tokenizer_file(name))
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


def keep_first_of_components(fps, sets):
    """The smallest id of each group over fingerprints within two bits and sets of similarity 0.8."""
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            alike = len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0
            if alike or ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {find(i) for i in ids}
