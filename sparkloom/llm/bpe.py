"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a word the greedy-merge encoding ends in one token.  That
token is found from left to right: the automaton lists the vocabulary entries
that end at the position, and the entry that is compatible with the last token
of the prefix before it is the only right one.  Back-pointers give the ids, in
time linear in the word and without simulating merges.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .scratch import bound_batches
from .words import texts_of

#: Words and token pairs that a worker keeps.
CACHE_WORDS, CACHE_PAIRS = 150_000, 1_000_000
#: Words longer than this are encoded but not kept.
CACHE_WORD_CHARS = 64
#: White space of the pre-tokenizer's regex engine: code points.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE = "".join(map(chr, SPACES))
# The pre-tokenizer's tables are those of Unicode 16.  Ranges of letters that came after it, which it takes
# for other characters, and capitals that came with it, which it lower-cases, with the distance of their small letters.
LATER_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191),
    (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
NEW_CAPITALS = {0x1C89: 1, 0xA7CB: 0x264 - 0xA7CB, 0xA7CC: 1, 0xA7DA: 1, 0xA7DC: 0x19B - 0xA7DC} | dict.fromkeys(range(0x10D50, 0x10D66), 0x20)
_LATER = "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER_LETTERS)
_CAPITALS = str.maketrans({c: chr(c + d) for c, d in NEW_CAPITALS.items()})
#: The same classes below U+0250, for which the standard library's faster engine is enough.
_LATIN = [chr(c) for c in range(0x250)]
_LATIN_LETTERS = "".join(c for c in _LATIN if unicodedata.category(c)[0] == "L")
_LATIN_NUMBERS = "".join(c for c in _LATIN if unicodedata.category(c)[0] == "N")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + k)
    return table


class BpeModel:
    """Vocabulary, merge ranks and edge chains of one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.names = {i: t for t, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.names.update({i: t for t, i in self.special.items()})
        vocab = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: (left id, right id) -> rank; token id -> (rank, left id, right id)
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            left, right = vocab[a], vocab[b]
            self.rank.setdefault((left, right), r)
            self.made.setdefault(vocab[a + b], (r, left, right))
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        alphabet = byte_alphabet()
        #: A final byte carries the suffix and is a symbol of its own.
        self.inner = {b: c for b, c in alphabet.items()}
        self.final = {b: chr(0x1000 + b) for b in alphabet}
        marks = {c + self.suffix: chr(0x1000 + b) for b, c in alphabet.items()}
        specials = set(self.special.values())
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if i in specials and i not in self.made:
                continue
            if i in self.made and not self._whole(i):
                continue  # no text is ever encoded as this token
            if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
                body = token[: -len(self.suffix)]
                key = body[:-1] + marks[body[-1] + self.suffix]
            else:
                key = token
            self.automaton.add_word(key, (len(key), i))
        self.automaton.make_automaton()
        lead = "'s|'t|'re|'ve|'m|'ll|'d"
        self.pattern = regex.compile(rf"(?V1){lead}|[\p{{L}}--[{_LATER}]]+|\p{{N}}|[[^{_SPACE}\p{{L}}\p{{N}}]||[{_LATER}]]+")
        self.latin = re.compile(rf"{lead}|[{_LATIN_LETTERS}]+|[{_LATIN_NUMBERS}]|[^{_SPACE}{_LATIN_LETTERS}{_LATIN_NUMBERS}]+")
        self.beyond_latin = re.compile(f"[{chr(0x250)}-{chr(0x10FFFF)}]")
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._words: dict[str, tuple[int, str, str]] = {}
        self._older: dict[str, tuple[int, str, str]] = {}

    def _edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """The tokens that stood at one edge while ``token`` was merged: (token, rank of the merge that used it up)."""
        chain, now, used = [], token, 1 << 60
        while True:
            chain.append((now, used))
            if now not in self.made:
                break
            used, a, b = self.made[now]
            now = b if right else a
        return chain[::-1]

    def _whole(self, token: int) -> bool:
        """Whether the token's own text is encoded as the token."""
        rank, a, b = self.made[token]
        return self._meets(a, b, rank) and all(x not in self.made or self._whole_memo(x) for x in (a, b))

    def _whole_memo(self, token: int) -> bool:
        memo = self.__dict__.setdefault("_memo", {})
        if token not in memo:
            memo[token] = self._whole(token)
        return memo[token]

    def _meets(self, left: int, right: int, until: int) -> bool:
        """No merge across the boundary comes before rank ``until``.

        Both edges are replayed in rank order: at each moment one token stands
        left of the boundary and one right of it; if their merge ranks before
        the merges that use them up, it would have taken place.
        """
        a = self._right.get(left) or self._right.setdefault(left, self._edge(left, True))
        b = self._left.get(right) or self._left.setdefault(right, self._edge(right, False))
        i = j = 0
        while True:
            (x, x_used), (y, y_used) = a[i], b[j]
            r = self.rank.get((x, y), 1 << 60)
            # Equal ranks: the leftmost pair goes first, inside the left token or at the boundary.
            if r < until and r < x_used and r <= y_used:
                return False
            if i + 1 == len(a) and j + 1 == len(b):
                return True
            if x_used <= y_used:
                i += 1
            else:
                j += 1

    def compatible(self, left: int, right: int) -> bool:
        if len(self._pairs) >= CACHE_PAIRS:
            self._pairs.clear()
        known = self._pairs[left << 24 | right] = self._meets(left, right, 1 << 60)
        return known

    def encode_symbols(self, symbols: str) -> list[int]:
        n = len(symbols)
        last, size = [-1] * (n + 1), [0] * (n + 1)  # of each prefix: its last token and that token's length
        pairs = self._pairs
        for end, (length, token) in self.automaton.iter(symbols):
            end += 1
            if last[end] >= 0:
                continue
            if length < end:
                before = last[end - length]
                if before < 0:
                    continue
                fits = pairs.get(before << 24 | token)
                if fits is None:
                    fits = self.compatible(before, token)
                if not fits:
                    continue
            last[end] = token
            size[end] = length
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        return out[::-1]

    def encode_word(self, word: str) -> list[int]:
        if self.suffix and word.isascii() and word.isprintable() and " " not in word:
            return self.encode_symbols(word[:-1] + self.final[ord(word[-1])])
        data = word.encode("utf-8")
        inner = self.inner
        if self.suffix:
            return self.encode_symbols("".join([inner[b] for b in data[:-1]]) + self.final[data[-1]])
        return self.encode_symbols("".join([inner[b] for b in data]))

    def word(self, word: str) -> tuple[int, str, str]:
        """(number of ids, ids as text, decoded text)."""
        known = self._words.get(word)
        if known is None:
            known = self._older.get(word)
            if known is None:
                ids = self.encode_word(word)
                known = (len(ids), " ".join(map(str, ids)), " ".join([self.names[i] for i in ids]))
            if len(word) <= CACHE_WORD_CHARS:
                if len(self._words) >= CACHE_WORDS:  # two generations: words in use live on
                    self._older, self._words = self._words, {}
                self._words[word] = known
        return known

    def normalized(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").translate(_CAPITALS)  # letter by letter: no final sigma
        return text.lower()

    def words_of(self, text: str) -> list[str]:
        text = self.normalized(text)
        if text.isascii() or not self.beyond_latin.search(text):
            return self.latin.findall(text)
        return self.pattern.findall(text)

    def encode_parts(self, text: str) -> list[tuple[int, str, str]]:
        word = self.word
        if self.split_special is None or not self.split_special.search(text):
            return [word(w) for w in self.words_of(text)]
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out += [word(w) for w in self.words_of(text[at : m.start()])]
            i = self.special[m.group()]
            out.append((1, str(i), self.names[i]))
            at = m.end()
        return out + [word(w) for w in self.words_of(text[at:])]

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.encode_parts(text) for i in p[1].split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as for tokenizer files without a decoder."""
        return " ".join([self.names[i] for i in ids])


_MODELS: dict[str, BpeModel] = {}


def _model(path: str) -> BpeModel:
    """One model a worker process, whatever the number of tasks."""
    if path not in _MODELS:
        _MODELS[path] = BpeModel(path)
    return _MODELS[path]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded), or with ``digests`` (doc_id, n_tokens, ids_sha256, decoded_sha256).

    Whole texts; null is empty and gives no ids.  Nothing is shuffled: each task
    encodes the rows it reads, and words met before come from a bounded cache.
    Strings of special tokens in a text become those tokens, as in the
    tokenizers library.  ``decoded`` is the decoding of the ids.  Repeated rows
    give repeated results; an empty table an empty one.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        model = _model(vocabulary)
        for batch in batches:
            counts: list[int] = []
            ids: list[object] = []
            texts: list[str] = []
            pending = 0
            start = 0
            column = texts_of(batch, "text")
            for k, raw in enumerate(column):
                parts = model.encode_parts((raw or b"").decode("utf-8", "replace"))
                counts.append(sum([p[0] for p in parts]))
                # A word always has an id, so joining the words' lists joins all ids.
                id_text, decoded = " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])
                if digests:
                    ids.append(hashlib.sha256(id_text.encode()).hexdigest())
                    texts.append(hashlib.sha256(decoded.encode()).hexdigest())
                else:
                    ids.append([int(i) for i in id_text.split()])
                    texts.append(decoded)
                    pending += counts[-1] * 16
                if pending > 16_000_000 or k + 1 == len(column):
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(start, k + 1 - start),
                            pa.array(counts, pa.int64()),
                            pa.array(ids, pa.string() if digests else pa.list_(pa.int32())),
                            pa.array(texts, pa.string()),
                        ],
                        names=["doc_id", "n_tokens", "ids", "decoded"],
                    )
                    counts, ids, texts, pending, start = [], [], [], 0, k + 1

    bound_batches(docs.sparkSession)
    part = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = part.schema["doc_id"].dataType.simpleString()
    out = part.mapInArrow(work, f"doc_id {kind}, n_tokens bigint, ids {'string' if digests else 'array<int>'}, decoded string")
    return out.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"}) if digests else out


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded); a null list decodes to the empty text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([model.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "decoded"]
            )

    part = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return part.mapInArrow(work, f"doc_id {part.schema['doc_id'].dataType.simpleString()}, decoded string")
