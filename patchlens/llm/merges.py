"""Byte-pair vocabularies as merge rules, and which two tokens may stand side by side.

A sequence of tokens is the encoding of its text exactly if every neighbouring pair is the
encoding of its own two texts. `Merges.together` answers that for a pair from the life spans
of the pieces at the seam, without encoding anything.
"""

import base64
import json
import re

START = -1  # stands for "nothing before"
NEVER = 1 << 60


class Merges:
    """Symbols are integers. `rank(x, y)` is the priority of joining two of them, or None."""

    def __init__(self, spelling, rank, joined, base):
        self.spelling = spelling  # symbol -> tuple of base symbols
        self.rank = rank
        self.joined = joined  # (x, y) -> symbol
        self.base = base  # set of base symbols
        self._split: dict[int, tuple[int, int, int] | None] = {}
        self.seen: dict[int, bool] = {}  # answers of together, by both symbols
        self._seams: tuple[dict, dict] = ({}, {})

    def reduce(self, symbols) -> list[int]:
        """The definition: join the pair of lowest rank, leftmost first, while there is one."""
        parts = list(symbols)
        while True:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                r = self.rank(parts[i], parts[i + 1])
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                return parts
            parts[at : at + 2] = [self.joined(parts[at], parts[at + 1])]

    def split(self, token: int):
        """(left, right, rank) of the join that makes the token, None for base symbols and for tokens no text gives."""
        if token not in self._split:
            self._split[token] = self._last_join(token)
        return self._split[token]

    def _last_join(self, token: int):
        parts, last = list(self.spelling(token)), None
        while len(parts) > 1:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                r = self.rank(parts[i], parts[i + 1])
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                return None
            last = (parts[at], parts[at + 1], best)
            parts[at : at + 2] = [self.joined(parts[at], parts[at + 1])]
        return last if parts[0] == token else None

    def reachable(self, token: int) -> bool:
        return token in self.base or self.split(token) is not None

    def _seam(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """Pieces that stand at one end of the token while it is built: (symbol, born, gone)."""
        known = self._seams[side].get(token)
        if known is None:
            known, at, gone = [], token, NEVER
            while True:
                made = self.split(at) if at not in self.base else None
                born = made[2] if made else -1
                known.append((at, born, gone))
                if not made:
                    break
                at, gone = made[side], born
            self._seams[side][token] = known
        return known

    def together(self, x: int, y: int) -> bool:
        """Whether the encoding of text(x) + text(y) is [x, y]."""
        if x == START:
            return True
        key = x << 20 | y
        known = self.seen.get(key)
        if known is None:
            if len(self.seen) > 400_000:
                self.seen.clear()
            known = self.seen[key] = self.stay_apart(x, y)
        return known

    def stay_apart(self, x: int, y: int) -> bool:
        """What `together` remembers, worked out."""
        left = self._seam(x, 1)
        for b, born_b, gone_b in self._seam(y, 0):
            for a, born_a, gone_a in left:
                if born_a < gone_b and born_b < gone_a:  # both stand at some time
                    r = self.rank(a, b)
                    # At equal rank the join further left comes first: a's own end is left of the seam, b's is right of it.
                    if r is not None and r < gone_a and r <= gone_b:
                        return False
        return True


def _printable() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary file stands for (fixed format)."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def common_pattern(pattern: str):
    """(findall, is_rare): the pattern for texts of common characters, and a test for any others.

    `regex` knows character classes that `re` lacks; written out for the characters below
    U+0300 and common punctuation, they let the faster of the two do most texts.
    """
    import regex

    common = [*map(chr, range(0x300)), *map(chr, range(0x2010, 0x2028)), *map(chr, range(0x2030, 0x2045)), "\u20ac"]
    common = [ch for ch in common if ch not in "\x1c\x1d\x1e\x1f\u0130"]  # blanks only to `re`; two letters in lower case

    def listed(chars: list[str]) -> str:
        return "".join(map(re.escape, chars))

    written = pattern
    for name in (r"\p{L}", r"\p{N}"):
        members = listed([ch for ch in common if regex.match(name, ch)])
        written = re.sub(rf"\[{re.escape(name)}\]", lambda _: f"[{members}]", written)
        inside = re.compile(rf"(\[[^\[\]]*){re.escape(name)}")
        while inside.search(written):
            written = inside.sub(lambda m: m.group(1) + members, written, count=1)
        written = written.replace(name, f"[{members}]")
    return re.compile(written).findall, re.compile(f"[^{listed(common)}]").search


class Trie:
    """Byte strings with up to two values each. The child of a node is at[node << 8 | byte], the root 0."""

    def __init__(self, first: dict[bytes, int], second: dict[bytes, int]):
        self.at: dict[int, int] = {}
        self.first: list[int | None] = [None]
        self.second: list[int | None] = [None]
        for values, listed in ((self.first, first), (self.second, second)):
            for raw, value in listed.items():
                node = 0
                for byte in raw:
                    key = node << 8 | byte
                    node = self.at.get(key, 0)
                    if not node:
                        node = self.at[key] = len(self.first)
                        self.first.append(None)
                        self.second.append(None)
                values[node] = value
        self.inner_nodes = {key >> 8 for key in self.at}  # those with children


class Recent(dict):
    """Values of `make` for the keys used last: two generations, the older one dropped when the newer is full."""

    def __init__(self, make, size: int, longest_key: int = 64):
        super().__init__()
        self.make, self.size, self.longest_key, self.older = make, size // 2, longest_key, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= self.longest_key:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class WordMerges(Merges):
    """A vocabulary whose last symbol of a word is a symbol of its own.

    `inner` and `final` give the token of a byte string inside a word and at its end.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        end, ids, byte_of = model["end_of_word_suffix"], model["vocab"], _printable()
        self.special = [x["content"] for x in whole["added_tokens"]]
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        spelled: dict[int, tuple[bytes, bool]] = {}
        for text, token in ids.items():
            last = text.endswith(end)
            body = text[: -len(end)] if last else text
            if all(ch in byte_of for ch in body):
                raw = bytes(byte_of[ch] for ch in body)
                (self.final if last else self.inner)[raw] = token
                spelled[token] = (raw, last)
        ranks = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ranks[ids[a], ids[b]] = (r, ids[a + b])
        inner, final = dict(self.inner), dict(self.final)

        def spelling(token: int):
            raw, last = spelled[token]
            symbols = [inner[raw[i : i + 1]] for i in range(len(raw))]
            if last:
                symbols[-1] = final[raw[-1:]]
            return symbols

        base = {t for t, (raw, _) in spelled.items() if len(raw) == 1}
        super().__init__(spelling, lambda x, y: ranks.get((x, y), (None,))[0], lambda x, y: ranks[x, y][1], base)
        self.inner = {raw: t for raw, t in inner.items() if self.reachable(t)}
        self.final = {raw: t for raw, t in final.items() if self.reachable(t)}
        #: Read backwards, from the end of a token.
        self.endings = Trie({raw[::-1]: t for raw, t in self.inner.items()}, {raw[::-1]: t for raw, t in self.final.items()})
        self.longest = max(map(len, self.inner.keys() | self.final.keys()))


class RankMerges(Merges):
    """A rank file: any two pieces whose concatenation is listed may join, at its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            ids = {base64.b64decode(raw): int(rank) for raw, rank in (line.split() for line in file if line.strip())}
        raw_of = {t: raw for raw, t in ids.items()}
        self.ids, self.raw_of = ids, raw_of

        def spelling(token: int):
            raw = raw_of[token]
            return [ids[raw[i : i + 1]] for i in range(len(raw))]

        base = {t for raw, t in ids.items() if len(raw) == 1}
        super().__init__(spelling, lambda x, y: ids.get(raw_of[x] + raw_of[y]), lambda x, y: ids[raw_of[x] + raw_of[y]], base)
        self.tokens = {raw: t for raw, t in ids.items() if self.reachable(t)}
        self.trie = Trie(self.tokens, {})
