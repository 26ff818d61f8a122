"""Byte-level BPE: encoding by a queue of merge ranks, decoding by concatenation.

A text is cut at added tokens, then at blanks (where the pre-tokenizer's
pattern always cuts), and each distinct word by that pattern.  The bytes
of each piece form a doubly linked list; a priority queue holds the ranks of
adjacent pairs that the vocabulary merges.  The least rank (leftmost first) is
merged and its new neighbours are queued; entries whose symbols have changed
since are stale and skipped.  A piece of n bytes costs O(n log n).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import annotate

#: Fixed value: the pattern of byte-level pre-tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of words remembered by a task, about; beyond it the memory starts anew.
REMEMBERED = 3 << 26
#: Bytes besides its letters that a remembered word takes, and the longest remembered.
ENTRY, LONG_PIECE = 200, 256


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """Character -> byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


def _odd(ch: str) -> bool:
    """Whether a character may count as white space: all that does is not printable, or the blank."""
    return ch == " " or not ch.isprintable()


def blank_edged(word: str) -> bool:
    """Whether a word between blanks begins or ends with what may be white space, or is empty."""
    return not word or not (word[0] + word[-1]).isprintable()


def joined_blanks(words: list[str]) -> list[str]:
    """Words of a text cut at blanks, with cuts within a run of white space undone.

    The pattern of pre-tokenizers never takes a blank after another character
    than white space, and leaves the last of a run to what follows; so a cut
    before a blank falls between pieces where white space is missing on one
    side at least.
    """
    out = words[:1]
    for w in words[1:]:
        if (not out[-1] or _odd(out[-1][-1])) and (not w or _odd(w[0])):
            out[-1] += " " + w
        else:
            out.append(w)
    return out


def strung(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + length], one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    return flat[np.repeat((starts - ends + lengths).astype(kind), lengths) + np.arange(total, dtype=kind)]


class WordEncoder:
    """Texts to ids through their distinct words.

    Texts are cut at blanks and their words numbered in Arrow; ``encode_words``
    makes the ids of each new string by itself, and those of a blank and a word
    are remembered up to ``remembered`` bytes.  Texts that hold one of ``added``
    go to ``encode_whole``; those with a run of white space around a blank are
    cut by ``joined_blanks``.
    """

    def __init__(self, encode_words: Callable[[list[str]], list[bytes]], encode_whole: Callable[[str], bytes], added: Sequence[str], remembered: int = REMEMBERED):
        self.encode_words, self.encode_whole, self.added = encode_words, encode_whole, list(added)
        self.memory: dict[str, bytes] = {}
        self.held, self.remembered = 0, remembered

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of a blank and each of the words."""
        if self.held > self.remembered:
            self.memory.clear()
            self.held = 0
        found = list(map(self.memory.get, words))
        new = [w for w, x in zip(words, found) if x is None]
        if not new:
            return found
        made = self.encode_words([" " + w for w in new])
        if max(map(len, new)) > LONG_PIECE:
            self.memory.update((w, x) for w, x in zip(new, made) if len(w) <= LONG_PIECE)
        else:
            self.memory.update(zip(new, made))
        self.held += sum(map(len, new)) + sum(map(len, made)) + ENTRY * len(new)
        rest = iter(made)
        return [next(rest) if x is None else x for x in found]

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text (null: none) as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if any(t in text for t in self.added):
            return self.encode_whole(text)
        words = joined_blanks(text.split(" "))
        first = self.encode_words(words[:1]) if words[0] else []
        return b"".join(first + self._ids(words[1:]))

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none) in a row, and where each text's end."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        n = len(texts)
        if not n:
            return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        odd = np.zeros(n, dtype=bool)
        for t in self.added:
            odd |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(texts, " ")
        at = cut.offsets.to_numpy().astype(np.int64)
        numbered = cut.flatten().dictionary_encode()
        number, words = numbered.indices.to_numpy().astype(np.int64), numbered.dictionary
        some = np.flatnonzero(pc.match_substring_regex(words, r"^$|^[^!-~]|[^!-~]$").to_numpy(zero_copy_only=False))
        edged = [i for i in some.tolist() if blank_edged(words[i].as_py())]
        if edged:
            flag = np.zeros(len(words), dtype=bool)
            flag[edged] = True
            odd |= np.logical_or.reduceat(flag[number], at[:-1])
        # A text's first word has no blank before it.
        firsts = words.take(pa.array(number[at[:-1]])).dictionary_encode()
        ids = self._ids(words.to_pylist()) + self.encode_words(firsts.dictionary.to_pylist())
        number[at[:-1]] = len(words) + firsts.indices.to_numpy()
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = strung(np.frombuffer(b"".join(ids), dtype="<u4"), (np.cumsum(size) - size)[number], size[number])
        ends = np.cumsum(size[number])[at[1:] - 1]
        if not odd.any():
            return flat, ends
        parts = np.split(flat, ends[:-1])
        for i in np.flatnonzero(odd).tolist():
            parts[i] = np.frombuffer(self.encode(texts[i].as_py()), dtype="<u4")
        return np.concatenate(parts), np.cumsum(list(map(len, parts)))


def plain_byte_level(spec: dict) -> bool:
    """Whether a tokenizer file asks for byte-level BPE cut by ``PATTERN``, and for nothing else."""
    cut, model, added = spec.get("pre_tokenizer") or {}, spec.get("model") or {}, spec.get("added_tokens") or []
    plain = not spec.get("normalizer") and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    odd = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")
    plain = plain and model.get("type", "BPE") == "BPE" and not any(model.get(x) for x in odd)
    return bool(plain) and not any(t.get(x) for t in added for x in ("normalized", "lstrip", "rstrip", "single_word"))


class ByteBpe:
    """Encoder and decoder of one vocabulary file (JSON, plain byte-level BPE; any other is an error)."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not plain_byte_level(spec):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        model, alphabet = spec["model"], byte_alphabet()
        vocab = model["vocab"]
        self.byte_id = [0] * 256
        for ch, b in alphabet.items():
            self.byte_id[b] = vocab[ch]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.strings = {i: bytes(alphabet[c] for c in s) for s, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings |= {i: s.encode() for s, i in self.added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self._cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self._pieces = regex.compile(PATTERN).findall
        self.words = WordEncoder(lambda words: list(map(self._encode_short, words)), self._encode_whole, list(self.added), remembered)
        self.string_at = np.zeros(max(self.strings) + 2, dtype=np.int64)
        for i, x in self.strings.items():
            self.string_at[i + 1] = len(x)
        self.string_size = self.string_at[1:].copy()
        self.string_at = np.cumsum(self.string_at)[:-1]
        self.letters = np.frombuffer(b"".join(self.strings.get(i, b"") for i in range(len(self.string_at))), dtype=np.uint8)

    def encode_piece(self, piece: bytes) -> list[int]:
        sym = [self.byte_id[b] for b in piece]
        n, merges = len(sym), self.merges
        if n < 2:
            return sym
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(m[0], i, sym[i], sym[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((sym[i], sym[i + 1])))]
        heapify(queue)
        while queue:
            _, i, a, b, made = heappop(queue)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j], k = made, -1, after[j]
            after[i] = k
            if k >= 0:
                before[k] = i
                if m := merges.get((made, sym[k])):
                    heappush(queue, (m[0], i, made, sym[k], m[1]))
            h = before[i]
            if h >= 0 and (m := merges.get((sym[h], made))):
                heappush(queue, (m[0], h, sym[h], made, m[1]))
        return [s for s in sym if s >= 0]

    def _encode_short(self, part: str) -> bytes:
        ids: list[int] = []
        for piece in self._pieces(part):
            ids += self.encode_piece(piece.encode())
        return np.array(ids, dtype="<u4").tobytes()

    def _encode_whole(self, text: str) -> bytes:
        """Cut at added tokens first."""
        out = []
        for i, part in enumerate(self._cut.split(text)):
            out.append(np.array([self.added[part]], dtype="<u4").tobytes() if i % 2 else self.words.encode(part))
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text (null: none) as little-endian unsigned 32-bit integers."""
        return self.words.encode(text)

    def decode(self, ids: bytes) -> str:
        """Text of ids: their vocabulary strings joined, invalid UTF-8 replaced."""
        flat = np.frombuffer(ids, dtype="<u4")
        return self.decode_all(flat, np.array([len(flat)]))[0]

    def decode_all(self, flat: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of ids in a row that end where ``ends`` says."""
        size = self.string_size[flat]
        raw = strung(self.letters, self.string_at[flat], size).tobytes()
        at = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], ends])].tolist()
        return [raw[i:j].decode("utf-8", "replace") for i, j in zip(at, at[1:])]


def binary_runs(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of ids in a row that end where ``ends`` says."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * 4
    if offsets[-1] >= 1 << 31:
        raise ValueError("more ids in a batch than a binary column holds")
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat, dtype="<u4"))])


@lru_cache(maxsize=2)
def _coder(path: str, remembered: int = REMEMBERED) -> ByteBpe:
    return ByteBpe(path, remembered)


def encode_texts(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, decoded: bool = False, keep: list[str] | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """Append ``token_ids`` (binary: unsigned 32-bit integers, little-endian) and ``n_tokens``.

    ``decoded`` appends ``decoded_text``, the ids turned back into text.  Null
    and empty texts have no tokens and decode to the empty text.  Same-named
    columns are replaced; every row keeps its place, without a shuffle.
    ``vocabulary`` is a path that every executor can read.  ``remembered``
    bounds the bytes of words that a worker keeps, and changes no result.
    """
    path = vocabulary or default_vocabulary()
    fields = [T.StructField("token_ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    if decoded:
        fields.append(T.StructField("decoded_text", T.StringType()))

    def make():
        coder = _coder(path, remembered)

        def run(texts):
            flat, ends = coder.words.encode_array(texts)
            out = [binary_runs(flat, ends), np.diff(ends, prepend=0)]
            return [*out, coder.decode_all(flat, ends)] if decoded else out

        return run

    return annotate(docs, text_col, make, fields, keep)


def decode_ids(df: DataFrame, ids_col: str = "token_ids", vocabulary: str | None = None) -> DataFrame:
    """Append ``decoded_text`` of a binary column of ids; null ids give null."""
    path = vocabulary or default_vocabulary()
    names = df.columns
    schema = T.StructType([f for f in df.schema if f.name != "decoded_text"] + [T.StructField("decoded_text", T.StringType())])

    def run(batches):
        import pyarrow as pa

        coder = _coder(path)
        for batch in batches:
            texts = [None if x.as_py() is None else coder.decode(x.as_py()) for x in batch.column(names.index(ids_col))]
            kept = [(n, batch.column(i)) for i, n in enumerate(names) if n != "decoded_text"]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.array(texts, pa.string())], names=[n for n, _ in kept] + ["decoded_text"])

    return df.mapInArrow(run, schema)
