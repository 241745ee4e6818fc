"""Byte-pair vocabularies and the exact facts about them that the token operators share.

A byte-level vocabulary merges neighbouring pieces in the order of the merged token's id.  A sequence of tokens is the
encoding of its bytes exactly when every two neighbours are *compatible*, that is when encoding the bytes of the two gives
the two back.  Both operators rest on that: prefix counting extends a prefix by one compatible token, tree encoding stops
growing a window when its edges are compatible.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import unicodedata
from functools import lru_cache

import regex

# A text falls into independent chunks: white space runs with the word that follows, since no piece of the splitting pattern
# goes on from a non-space into a space.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # Unicode's White_Space
CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_SETTLED = re.compile(r"[\x00-\u024f]*")  # characters whose class is the same in every Unicode version in use
MAX_CACHED_CHARS, MAX_CACHE = 48, 600_000
_NEVER = 1 << 40


class Cache(dict):
    """A memory of bounded size: emptied when full."""

    def put(self, key, value):
        if len(self) >= MAX_CACHE:
            self.clear()
        self[key] = value


class Vocabulary:
    """``tokens[id]`` is a token's bytes; ``merge(a, b)`` the id that two neighbouring ids merge into, or None."""

    def __init__(self, tokens: list[bytes], pairs: dict[tuple[int, int], int] | None):
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens) if t}
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self._pairs = pairs
        self._joined = Cache()
        self._is_whole: dict[int, bool] = {}

    def merge(self, a: int, b: int) -> int | None:
        if self._pairs is not None:
            return self._pairs.get((a, b))
        return self.ids.get(self.tokens[a] + self.tokens[b])

    def encode_plain(self, data: bytes) -> list[int]:
        """The encoding by merging the lowest pair first."""
        return self._encode_short(data) if len(data) <= 48 else self._encode_long(data)

    def _encode_short(self, data: bytes) -> list[int]:
        """Quadratic, with the ids that neighbours would merge into kept in a list."""
        if self._pairs is None:
            return self._encode_by_rank(data)
        merge = self.merge
        ids = [self.byte_ids[b] for b in data]
        into = [_NEVER if (m := merge(a, b)) is None else m for a, b in zip(ids, ids[1:], strict=False)]
        while into and (least := min(into)) != _NEVER:
            i = into.index(least)
            ids[i : i + 2] = [least]
            del into[i]
            if i:
                into[i - 1] = _NEVER if (m := merge(ids[i - 1], least)) is None else m
            if i < len(into):
                into[i] = _NEVER if (m := merge(least, ids[i + 1])) is None else m
        return ids

    def _encode_by_rank(self, data: bytes) -> list[int]:
        """The same where any two neighbours merge whose bytes together are a token: looked up by where tokens start."""
        get, n = self.ids.get, len(data)
        at = list(range(n + 1))
        into = [get(data[i : i + 2], _NEVER) for i in range(n - 1)]
        while into and (least := min(into)) != _NEVER:
            i = into.index(least)
            del at[i + 1], into[i]
            if i < len(into):
                into[i] = get(data[at[i] : at[i + 2]], _NEVER)
            if i:
                into[i - 1] = get(data[at[i - 1] : at[i + 1]], _NEVER)
        return [self.ids[data[a:b]] for a, b in zip(at, at[1:], strict=False)]

    def _encode_long(self, data: bytes) -> list[int]:
        """O(n log n): a heap of the pairs that can merge, with outdated entries skipped."""
        n = len(data)
        ids, after, before = [self.byte_ids[b] for b in data], list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merge(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            merged, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged already
            ids[i], ids[j] = merged, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := self.merge(merged, ids[k])) is not None:
                    heapq.heappush(heap, (m, i, merged, ids[k]))
            if (h := before[i]) >= 0 and (m := self.merge(ids[h], merged)) is not None:
                heapq.heappush(heap, (m, h, ids[h], merged))
        return [t for t in ids if t >= 0]

    def pair(self, a: int, b: int) -> list[int]:
        """The encoding of two tokens' bytes."""
        known = self._joined.get((a, b))
        if known is None:
            known = self.encode_plain(self.tokens[a] + self.tokens[b])
            self._joined.put((a, b), known)
        return known

    def compatible(self, a: int, b: int) -> bool:
        return self.pair(a, b) == [a, b]

    def whole(self, token: int) -> bool:
        """Whether a token's bytes are encoded as that token."""
        known = self._is_whole.get(token)
        if known is None:
            known = self._is_whole[token] = self.encode_plain(self.tokens[token]) == [token]
        return known


def _printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in a vocabulary kept as JSON text: printable Latin-1 bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=2)
def load_json(path: str) -> tuple[Vocabulary, tuple[str, ...]]:
    """A byte-level vocabulary file of the ``tokenizers`` library, and its special strings."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pre = spec["pre_tokenizer"]
    if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
        raise ValueError(f"{path} is not a plain byte-level vocabulary")
    back = _printable_bytes()
    vocab = spec["model"]["vocab"]
    tokens = [b""] * (max(vocab.values()) + 1)
    for text, i in vocab.items():
        tokens[i] = bytes(back[c] for c in text)
    pairs, last = {}, -1
    for pair in spec["model"]["merges"]:
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merged = vocab[left + right]
        if merged <= last:
            raise ValueError("merges are not in the order of their ids")
        pairs[vocab[left], vocab[right]] = last = merged
    return Vocabulary(tokens, pairs), tuple(t["content"] for t in spec["added_tokens"])


@lru_cache(maxsize=2)
def load_ranks(path: str) -> Vocabulary:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as file:
        ranks = dict(line.split() for line in file if line.strip())
    tokens = [b""] * (max(map(int, ranks.values())) + 1)
    for token, rank in ranks.items():
        tokens[int(rank)] = base64.b64decode(token)
    return Vocabulary(tokens, None)


def _ranges(code_points: list[int]) -> str:
    """The inside of a character class."""
    out, start, last = [], None, None
    for c in [*code_points, None]:
        if start is not None and c != last + 1:
            out.append(f"\\U{start:08x}-\\U{last:08x}")
            start = None
        if start is None:
            start = c
        last = c
    return "".join(out)


def _all_characters() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


def _letters_by_tokenizers(kind: str) -> str:
    from tokenizers import Regex, pre_tokenizers

    splitter = pre_tokenizers.Split(Regex(rf"\p{{{kind}}}+"), "removed", invert=True)
    return "".join(piece for piece, _ in splitter.pre_tokenize_str(_all_characters()))


def _letters_by_tiktoken(kind: str) -> str:
    import tiktoken

    encoding = tiktoken.Encoding(
        "probe", pat_str=rf"\p{{{kind}}}+", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={}
    )
    return bytes(encoding.encode_ordinary(_all_characters())).decode()


@lru_cache(maxsize=4)
def _splitter(pattern: str, library: str):
    """``pattern`` with the letter and number classes that the library itself uses, since Unicode versions differ."""
    probe = _letters_by_tokenizers if library == "tokenizers" else _letters_by_tiktoken
    for kind in ("L", "N"):
        pattern = _put_class(pattern, kind, _ranges(list(map(ord, probe(kind)))))
    return regex.compile(pattern)


def _put_class(pattern: str, kind: str, ranges: str) -> str:
    inside = regex.sub(r"(\[\^?[^\]]*)\\p\{" + kind + r"\}", lambda m: m[1] + ranges, pattern)
    return inside.replace(rf"\p{{{kind}}}", f"[{ranges}]")


@lru_cache(maxsize=4)
def _plain(pattern: str):
    return regex.compile(pattern)


@lru_cache(maxsize=4)
def _settled_splitter(pattern: str):
    """``pattern`` for settled characters by the standard library, which finds matches in a fraction of the time.

    Only for patterns of letter, number and white-space classes, as the public one; another pattern is left to ``regex``.
    """
    settled = [chr(c) for c in range(0x250)]
    letters, numbers = (_ranges([ord(c) for c in settled if unicodedata.category(c)[0] == kind]) for kind in "LN")
    spaces = _ranges([ord(c) for c in settled if regex.fullmatch(r"\s", c)])
    plain = pattern.replace(r"\S", f"[^{spaces}]")
    for name, inside in ((r"\p{L}", letters), (r"\p{N}", numbers), (r"\s", spaces)):
        plain = regex.sub(r"(\[\^?[^\]]*)" + regex.escape(name), lambda m, inside=inside: m[1] + inside, plain).replace(name, f"[{inside}]")
    if "\\p" in plain:
        return _plain(pattern)
    return re.compile(plain)


def split_text(text: str, pattern: str, library: str) -> list[str]:
    """The matches of the splitting pattern in a whole text, as the named library finds them."""
    if _SETTLED.fullmatch(text):
        return _settled_splitter(pattern).findall(text)
    pieces: list[str] = []
    for chunk in CHUNK.findall(text):
        if _SETTLED.fullmatch(chunk):
            pieces += _settled_splitter(pattern).findall(chunk)
        else:
            pieces += _splitter(pattern, library).findall(chunk)
    return pieces


def split(chunk: str, pattern: str, library: str) -> list[str]:
    """The matches of the splitting pattern in a chunk, as the named library finds them."""
    if _SETTLED.fullmatch(chunk):
        return _plain(pattern).findall(chunk)
    return _splitter(pattern, library).findall(chunk)
