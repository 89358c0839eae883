"""Plain Python versions of the operators, written from their definitions."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken
import xxhash

from postmill.llm import bpe

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = {c: c + 32 for c in range(65, 91)}
SHAPES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoding() -> tiktoken.Encoding:
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.RANKS))
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def fingerprint(text: str | None, width: int = 3) -> int:
    words = WORD.findall((text or "").translate(ASCII))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints: dict[int, int], bits: int = 2) -> dict[int, int]:
    name = {i: i for i in prints}

    def root(i: int) -> int:
        while name[i] != i:
            i = name[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = root(i), root(j)
                name[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def _luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in doubled) % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int, str]]:
    found = []
    for at, (kind, shape) in enumerate(SHAPES.items()):
        for m in re.finditer(shape, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and _luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), at, m.end(), kind))
    return sorted(found)


def listed(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)


def line_key(line: str) -> str:
    return line.strip(" \t\n\x0b\f\r").translate(ASCII)


def without_common_lines(texts: dict[int, str | None], min_docs: int) -> dict[int, tuple[int, int, str]]:
    found = defaultdict(set)
    for i, text in texts.items():
        for line in (text or "").split("\n"):
            found[line_key(line)].add(i)
    common = {k for k, docs in found.items() if k and len(docs) >= min_docs}
    out = {}
    for i, text in texts.items():
        lines = (text or "").split("\n")
        kept = [x for x in lines if line_key(x) not in common]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def figures(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    covered = {p for k in range(len(words) - 4) if windows[tuple(words[k:k + 5])] > 1 for p in range(k, k + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
