"""Token ids of many texts, as the tokenizers and sentencepiece libraries give them.

A byte-level BPE with the usual split pattern never joins what stands on both
sides of a space that follows a visible character, so that a text's ids are the
ids of its space-led words, one after the other.  Each worker keeps the ids of
words that it has met, and asks the library only for new ones.  What it keeps is
bounded in bytes, and strings of over ``LONGEST_KEPT`` characters (texts without
spaces are one word) are never kept.  Where words aren't independent (odd white
space, special strings inside a text, other kinds of tokenizer), whole texts go
to the library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of words, with their ids and what Python objects take, met since the last turn;
#: at each turn, words not met since the turn before go.
KEPT_BYTES = 160 << 20
#: Characters of a string whose ids may be kept, and bytes that its objects take besides.
LONGEST_KEPT, OBJECTS = 200, 250
#: Texts, and about how many characters, that are looked up together: each word once, new ones in one call of the library.
TOGETHER, CHARACTERS = 512, 2 << 20
#: Characters that go to the library in one string.
LONGEST_CALL = 100_000

#: A space between other white space, or between it and the end: words are not independent there.
_ODD = re.compile(r"\s (?:\s|\Z)")
#: Letters, marks, and perhaps letters and marks of another line: the split pattern cuts between these wherever they stand.
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", r"[!-&(-/:-@\[-`{-~]*"
_CUT = re.compile(f"({_LETTERS})({_MARKS})(?:\n({_LETTERS})({_MARKS}))?")
#: Bytes to the characters that stand for them in byte-level pieces, where these aren't the same as in Latin 1.
_AS_PIECE = {b: chr(256 + k) for k, b in enumerate([*range(33), *range(127, 161), 173]) if b >= 127}
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    def __init__(self, path: str):
        self.by_word = False
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: pieces.encode(texts, num_threads=1)
            return
        from tokenizers import Tokenizer, pre_tokenizers

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        self.whole = lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        made = json.loads(Path(path).read_text(encoding="utf-8"))
        split = made.get("pre_tokenizer") or {}
        self.special = [t["content"] for t in made.get("added_tokens", [])]
        self.by_word = (
            made["model"]["type"] == "BPE"
            and not made.get("normalizer")
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space")
        )
        if self.by_word:
            pieces = Tokenizer.from_file(path)  # for words of letters, already written as pieces: no pattern is needed to split them
            pieces.no_truncation()
            pieces.no_padding()
            pieces.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            self.letters = lambda text: pieces.encode_batch_fast([text], add_special_tokens=False)[0].ids
            vocab = tok.get_vocab(with_added_tokens=True)
            self.led = np.zeros(max(vocab.values()) + 1, bool)  # ids that begin with a space
            for piece, i in vocab.items():
                self.led[i] = piece.startswith("Ġ")
            self.words: dict[str, bytes] = {}  # met since the last turn
            self.older: dict[str, bytes] = {}  # met before it
            self.heads: dict[str, bytes] = {}
            self.size = 0  # bytes of words and heads since the last turn

    def _keep(self, kept: dict[str, bytes], words: list[str], ids: list[bytes]) -> None:
        kept.update(zip(words, ids, strict=True))
        self.size += OBJECTS * len(words) + 4 * sum(map(len, words)) + sum(map(len, ids))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        while len(out) < len(texts):
            first = stop = len(out)
            size = 0
            while stop < len(texts) and stop < first + TOGETHER and size < CHARACTERS:
                size += len(texts[stop])
                stop += 1
            out += self._some(texts[first:stop])
        return out

    def _some(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return _packed(self.whole(texts))
        out: list[bytes] = [b""] * len(texts)
        odd = [i for i, t in enumerate(texts) if any(s in t for s in self.special) or _ODD.search(t)]
        for i, ids in zip(odd, _packed(self.whole([texts[i] for i in odd])), strict=True):
            out[i] = ids
        rest = sorted(set(range(len(texts))) - set(odd))
        if self.size > KEPT_BYTES:
            self.older, self.words, self.heads, self.size = self.words, {}, {}, 0
        if rest:
            split = pc.split_pattern(pa.array([texts[i] for i in rest], pa.large_string()), " ")
            starts = split.offsets.to_numpy()
            coded = split.flatten().dictionary_encode()
            words, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
            first = [words[k] for k in at[starts[:-1]].tolist()]
            at[starts[:-1]] = len(words) + np.arange(len(rest))
            wanted = np.zeros(len(words) + len(rest), bool)
            wanted[at] = True
            ids = self._words(words, wanted[: len(words)].tolist()) + self._heads(first)
            joined = pa.array(ids, pa.large_binary()).take(pa.array(at))
            ends = np.frombuffer(joined.buffers()[1], np.int64, len(at) + 1)[starts].tolist()
            raw = memoryview(joined.buffers()[2] or b"")
            for i, a, z in zip(rest, ends, ends[1:], strict=False):
                out[i] = raw[a:z].tobytes()
        return out

    def _words(self, words: list[str], wanted: list[bool]) -> list[bytes | None]:
        """The ids of the distinct ``words`` that are wanted, each with the space before it."""
        got = [g if k else None for g, k in zip(map(self.words.get, words), wanted, strict=True)]
        gaps = [j for j, g in enumerate(got) if g is None and wanted[j]]
        new, long = {words[j] for j in gaps}, {}
        for w in [w for w in new if len(w) > LONGEST_KEPT]:
            new.remove(w)
            long[w] = _packed(self.whole([" " + w]))[0]
        met = [w for w in new if w in self.older]
        self._keep(self.words, met, [self.older[w] for w in met])
        new.difference_update(met)
        if new:
            self._learn(new)
        for j in gaps:
            w = words[j]
            got[j] = long[w] if w in long else self.words[w]
        return got

    def _heads(self, heads: list[str]) -> list[bytes]:
        """The ids of what stands at a text's beginning, or behind a mark or the end of a line."""
        new = list({h for h in heads if len(h) <= LONGEST_KEPT} - self.heads.keys())
        self._keep(self.heads, new, _packed(self.whole(new)))
        return [self.heads[h] if h in self.heads else _packed(self.whole([h]))[0] for h in heads]

    def _learn(self, new: set[str]) -> None:
        """Ask the library for words that are new here, each with the space before it."""
        letters, plain, alone, cut = [], [], [], []
        for w in new:
            found = _CUT.fullmatch(w)
            if found:
                if found.end(1) == len(w):
                    letters.append(w)
                else:
                    cut.append((w, *found.groups("")))
            elif not w or w[0].isspace() or w[-1].isspace():
                alone.append(w)
            else:
                plain.append(w)
        for base in {c[1] for c in cut if c[1] not in self.words and c[1] not in new}:
            if base in self.older:
                self._keep(self.words, [base], [self.older[base]])
            else:
                letters.append(base)
        self._keep(self.words, alone, _packed(self.whole([" " + w for w in alone])))
        self._ask(plain, lambda text: self.whole([text])[0])
        self._ask([w for w in letters if w.isascii()], lambda text: self.letters(text.replace(" ", " Ġ")))
        self._ask([w for w in letters if not w.isascii()], lambda text: self.letters(_as_pieces(text)))
        tails = list({t for _, _, *tail in cut for t in tail if t})
        of = dict(zip(["", "\n", *tails], self._heads(["", "\n", *tails]), strict=True))
        line = of["\n"]
        ids = [self.words[base] + of[marks] + (line + of[head] + of[last] if head else b"") for _, base, marks, head, last in cut]
        self._keep(self.words, [c[0] for c in cut], ids)

    def _ask(self, words: list[str], ids_of: Callable[[str], list[int]]) -> None:
        """Keep the ids of words that hold no white space at their ends; ``ids_of`` tells those of many, a space before each."""
        start = 0
        while start < len(words):
            stop, size = start, 0
            while stop < len(words) and size < LONGEST_CALL:
                size += len(words[stop]) + 1
                stop += 1
            part = words[start:stop]
            ids = np.array(ids_of(" " + " ".join(part)), "<u4")
            cuts = np.flatnonzero(self.led[ids])
            if len(cuts) == len(part):
                raw, at = ids.tobytes(), [*(cuts * 4).tolist(), len(ids) * 4]
                self._keep(self.words, part, [raw[a:b] for a, b in zip(at, at[1:], strict=False)])
            else:
                self._keep(self.words, part, _packed(self.whole([" " + w for w in part])))
            start = stop


def _as_pieces(text: str) -> str:
    """Space-led words of letters as byte-level pieces."""
    text = text.encode().decode("latin-1")
    for byte, piece in _AS_PIECE.items():
        text = text.replace(chr(byte), piece)
    return text.replace(" ", " Ġ")


def _packed(ids: list[list[int]]) -> list[bytes]:
    return [np.array(i, "<u4").tobytes() for i in ids]
