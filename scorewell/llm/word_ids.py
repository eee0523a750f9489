"""Token ids of many texts at once, where a tokenizer parts texts at white space and encodes the words by themselves.

Texts become words, words become different words, different words become parts and different parts, all in Arrow; only parts that were
not met before go through the tokenizers library, and ids are gathered back the same way. Other tokenizers, and texts with
characters that Arrow and the tokenizer may see differently, are encoded whole.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEPT, KEPT_LONGEST = 500_000, 64
_encoders: dict[str, WordIds] = {}


@dataclass(frozen=True)
class Rules:
    """How a kind of tokenizer may be taken apart. ``PART`` holds for words that match ``plain``, without any mark of special tokens.

    ``lower``: letters are lowered first. ``spaced``: white space belongs to the word after it; else it is dropped.
    """

    plain: str
    part: str
    lower: bool
    spaced: bool


#: By normalizers, first pre-tokenizer and its pattern.
KINDS = {
    (("NFC", "Replace", "Lowercase"), "Split", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"): Rules(
        "^[!-~À-ÖØ-öø-ÿ]+$", r"('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+)", True, False
    ),
    ((), "ByteLevel", None): Rules(
        "^ ?[!-~À-ÖØ-öø-ÿ]+$", r"('s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^ A-Za-z0-9À-ÖØ-öø-ÿ]+)", False, True
    ),
}
#: Texts with any of these are encoded whole: white space of other kinds, and the sign that marks cuts.
ODD_SPACED = "[\\x00\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
ODD = "[\\x00\\x1c-\\x1f]"


def rules_of(settings: dict) -> Rules | None:
    normalizer, first = settings.get("normalizer") or {}, settings.get("pre_tokenizer") or {}
    steps = normalizer.get("normalizers", [normalizer] if normalizer else [])
    first = first["pretokenizers"][0] if "pretokenizers" in first else first
    if first.get("add_prefix_space") or not first.get("use_regex", True) or first.get("behavior", "Removed") != "Removed":
        return None
    return KINDS.get((tuple(s["type"] for s in steps), first.get("type"), first.get("pattern", {}).get("Regex")))


def gather(values: np.ndarray, starts: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The segments ``values[starts[i]:starts[i + 1]]`` for each i of ``index`` one after another, and where each of them starts."""
    sizes = np.diff(starts)[index]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.repeat(starts[index] - ends[:-1], sizes) + np.arange(ends[-1])], ends


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


class WordIds:
    """Ids by the tokenizers library. Up to KEPT parts are remembered; when there are more, the four fifths that were met in most batches stay."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks in parallel
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.rules = rules_of(json.load(f))
        self.made = Tokenizer.from_file(path)
        vocabulary = self.made.get_vocab() if self.rules and not self.rules.spaced else {}
        self.last = np.isin(np.arange(self.made.get_vocab_size()), [i for t, i in vocabulary.items() if t.endswith("</w>")])
        self.keys, self.values, self.starts = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self.met = np.zeros(0, np.int32)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, and where each text's start."""
        ids: list[list[int]] = []
        for i in range(0, len(texts), 4096):
            ids += [x.ids for x in self.made.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.array([t for x in ids for t in x], "<u4"), _starts(sizes)

    def _library_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for parts of plain words, many to a text where the ids tell them apart."""
        if not self.last.any():
            return self._library(parts)
        made = self.made.encode_batch_fast([" ".join(parts[i : i + 64]) for i in range(0, len(parts), 64)], add_special_tokens=False)
        ids = np.array([t for x in made for t in x.ids], "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        return (ids, np.concatenate([[0], ends])) if len(ends) == len(parts) else self._library(parts)

    def _of_parts(self, parts: pa.Array, others: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different parts, and where each part's start. ``others`` are words that are not plain."""
        at = pc.fill_null(pc.index_in(parts, self.keys), -1).to_numpy().copy()
        self.met[at[at >= 0]] += 1
        fresh = np.flatnonzero(at < 0)
        new = parts.take(pa.array(fresh))
        whole = pc.is_in(new, others)
        groups = [new.filter(pc.invert(whole)), new.filter(whole)]
        found = [self._library_parts(groups[0].to_pylist()), self._library(groups[1].to_pylist())]
        at[fresh[np.argsort(whole.to_numpy(False), kind="stable")]] = len(self.keys) + np.arange(len(new))
        self.keys = pa.concat_arrays([self.keys, *groups])
        self.values = np.concatenate([self.values, *[v for v, _ in found]])
        self.starts = np.concatenate([self.starts, _starts(np.concatenate([np.diff(s) for _, s in found]))[1:] + self.starts[-1]])
        self.met = np.concatenate([self.met, np.ones(len(new), np.int32)])
        out = gather(self.values, self.starts, at)
        if len(self.keys) > KEPT:
            self.met[pc.greater(pc.binary_length(self.keys), KEPT_LONGEST).to_numpy(False)] = 0  # words without end
            stay = np.sort(np.argpartition(-self.met, KEPT * 4 // 5)[: KEPT * 4 // 5])
            self.values, self.starts = gather(self.values, self.starts, stay)
            self.keys, self.met = self.keys.take(pa.array(stay)), self.met[stay] // 2
        return out

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, and where each word's start."""
        # Special tokens are looked for in the text as it stands, so what may hold one is encoded as it stands.
        plain = pc.and_not(pc.match_substring_regex(words, self.rules.plain), pc.match_substring(words, "<|"))
        cut = words.filter(plain)
        cut = pc.replace_substring_regex(pc.utf8_lower(cut) if self.rules.lower else cut, self.rules.part, "\x00\\1")
        others = words.filter(pc.invert(plain))
        lists = [pc.split_pattern(cut, "\x00"), pa.ListArray.from_arrays(pa.array(np.arange(len(others) + 1), pa.int32()), others)]
        parts = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        sizes = np.concatenate([pc.list_value_length(x).to_numpy() for x in lists])
        values, ends = gather(*self._of_parts(parts.dictionary, others), parts.indices.to_numpy())
        # Back to the order in which the words came.
        order = np.argsort(np.concatenate([np.flatnonzero(plain), np.flatnonzero(pc.invert(plain))]), kind="stable")
        return gather(values, ends[_starts(sizes)], order)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (no nulls) as little-endian unsigned 32-bit integers."""
        r = self.rules
        odd = pc.match_substring_regex(texts, ODD_SPACED if r.spaced else ODD) if r else pa.array([True] * len(texts), pa.bool_())
        out = np.empty(len(texts), object)
        for mine, found in ((odd, self._whole), (pc.invert(odd), self._by_words)):
            some = texts.filter(mine)
            if len(some):
                values, starts = found(some)
                data, at = values.tobytes(), (4 * starts).tolist()
                out[np.flatnonzero(mine)] = [data[a:b] for a, b in zip(at, at[1:])]
        return out.tolist()

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self._library(texts.to_pylist())

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.rules.spaced:  # cut before each run of white space
            lists = pc.split_pattern(pc.replace_substring_regex(texts, "([^ \n\r\t])([ \n\r\t])", "\\1\x00\\2"), "\x00")
        else:
            lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        values, ends = gather(*self._of_words(words.dictionary), words.indices.to_numpy())
        return values, ends[_starts(pc.list_value_length(lists).to_numpy())]


def encoder(path: str) -> WordIds:
    """One per tokenizer file and process."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]
