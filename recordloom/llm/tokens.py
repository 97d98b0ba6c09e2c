"""Encoding with the public tokenizer files, through a worker's cache of pre-tokens.

A byte-pair tokenizer encodes each pre-token by itself, and most pre-tokens of a
corpus are repeats. So a text of plain characters is cut by the tokenizer's own
pre-token pattern, repeats come from a dictionary, and the tokenizers library
encodes only what the dictionary lacks. Any text with a character outside PLAIN,
or with what could be a special token, goes to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable

#: Latin letters and numbers up to U+00FF, as Unicode classes them, and ASCII white space.
LETTER, NUMBER, BLANK = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r "
#: Characters of which every Unicode version says the same: they are in composed form and of known class.
PLAIN = re.compile("[\t-\r -~¡-ÿ‐-‧€]*")
#: Pre-tokens of each tokenizer (fixed values of the two files): pattern, whether texts are lowered first, what marks a special token.
#: Alternatives that can't start alike are in order of frequency.
KINDS = {
    "byte": (re.compile(rf" ?[{LETTER}]+| ?[{NUMBER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{BLANK}{LETTER}{NUMBER}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"), False, "<|endoftext|>"),
    "word": (re.compile(rf"[{LETTER}]+|[{NUMBER}]|'s|'t|'re|'ve|'m|'ll|'d|[^{BLANK}{LETTER}{NUMBER}]+"), True, "<|"),
}

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer, once for each worker process; it runs no threads of its own."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def kind_of(path: str) -> str | None:
    """Which pre-token rule the file has; None (always the library) for one that isn't known here."""
    import json

    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    if d.get("normalizer") is None and d["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and [t["content"] for t in d["added_tokens"]] == ["<|endoftext|>"]:
        return "byte"
    if d.get("normalizer") and d["model"].get("end_of_word_suffix") == "</w>" and all(t["content"].startswith("<|") for t in d["added_tokens"]):
        return "word"
    return None


def pre_tokens(text: str, kind: str | None) -> list[str] | None:
    """The text's pre-tokens, or None where only the library may cut it."""
    if kind is None:
        return None
    pattern, lower, special = KINDS[kind]
    if special in text or PLAIN.fullmatch(text) is None:
        return None
    return pattern.findall(text.lower() if lower else text)


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow each other from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_CHARS = _byte_chars()


class Encoder:
    """Maps texts to what ``pack`` makes of their ids; ``join`` puts together what pre-tokens gave.

    The cache of pre-tokens has two generations of at most ``limit`` entries each; ``first`` is a tier that is never
    dropped. What is in neither has the library's model encode it.
    """

    def __init__(self, path: str, pack: Callable, join: Callable, first: dict | None = None, limit: int = 400_000):
        self.path, self.kind, self.pack, self.join = path, kind_of(path), pack, join
        self.model, self.first, self.limit = tokenizer(path).model, first or {}, limit
        self.cache, self.old = dict(self.first), {}

    def _missing(self, w: str):
        r = self.old.get(w)
        if r is None:
            r = self.pack([t.id for t in self.model.tokenize(w.encode().decode("latin-1").translate(BYTE_CHARS))])
        if len(w) <= 64:
            self.cache[w] = r
        return r

    def batch(self, texts: Iterable[str]) -> list:
        """One result for each text, in order."""
        out, get = [], self.cache.get
        for t in texts:
            cut = pre_tokens(t, self.kind)
            if cut is None:
                out.append(self.pack(tokenizer(self.path).encode(t, add_special_tokens=False).ids))
                continue
            got, at = list(map(get, cut)), 0
            for _ in range(got.count(None)):
                at = got.index(None, at)
                got[at] = get(cut[at]) or self._missing(cut[at])
            out.append(self.join(got))
            if len(self.cache) > self.limit:
                self.old, self.cache = self.cache, dict(self.first)
                get = self.cache.get
        return out


_encoders: dict[tuple, Encoder] = {}


def ids_encoder(path: str) -> Encoder:
    """Gives each text's ids as little-endian unsigned 32-bit bytes; one for a worker process, which keeps its cache between tasks."""
    if ("ids", path) not in _encoders:
        _encoders["ids", path] = Encoder(path, lambda ids: array("I", ids).tobytes(), b"".join)
    return _encoders["ids", path]


def count_encoder(path: str, tier: str, first: Callable[[], dict[str, int]]) -> Encoder:
    """Gives each text's number of ids; ``tier`` names the first tier, which ``first`` makes."""
    if ("count", path, tier) not in _encoders:
        for k in [k for k in _encoders if k[:2] == ("count", path)]:
            del _encoders[k]
        _encoders["count", path, tier] = Encoder(path, len, sum, first())
    return _encoders["count", path, tier]
