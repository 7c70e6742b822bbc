"""BPE encoding and decoding with a given vocabulary, by batched merge rounds in numpy.

The distinct new words of a batch lie one after another in one flat array of symbols. In each round every word merges
its pair of lowest rank; ranks are found for all neighbouring pairs at once by binary search over the sorted pair
keys. Words that have no pair left drop out. A long word also merges pairs that are the lowest within the length of a
token. Encoded words are kept per worker up to a bound of words and of bytes, those used of late longest.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Collection, Iterable, Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import chunks

#: Above this code point the Unicode tables of the regex module and of the tokenizers library differ in places.
SAME_TABLES = 0x557
#: The split of byte-level vocabularies that name no pattern of their own.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.iinfo(np.int64).max


def least_before(ranks: np.ndarray, width: int) -> np.ndarray:
    """The lowest of the ``width`` values before each; ``NONE`` where there is none."""
    least, size = np.full(len(ranks), NONE), 1
    least[1:] = ranks[:-1]
    while size < width:
        step = min(size, width - size)
        least[step:] = np.minimum(least[step:], least[:-step])
        size += step
    return least


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


class BPE:
    """A byte-level BPE vocabulary in the JSON format of the tokenizers library.

    Known normalizers: NFC, white space to blanks, lower case; known splits: a pattern whose matches are kept, or
    the byte-level pattern. Anything else raises ``ValueError``. Special tokens in a text are matched as such.
    """

    def __init__(self, text: str, most_words: int = 200_000, most_bytes: int = 64 << 20):
        config = json.loads(text)
        model = config["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("not a plain byte-level BPE vocabulary")
        self.json = text
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        known = [t for t in config["added_tokens"] if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]]
        if known:
            raise ValueError("special tokens with options of their own")
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.find_special = None
        if self.special:
            self.find_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.read_normalizer(config["normalizer"])
        self.read_split(config["pre_tokenizer"])
        self.spaced = config["decoder"] is None
        if not self.spaced and config["decoder"]["type"] != "ByteLevel":
            raise ValueError("decoder")
        letters = byte_letters()
        self.bytes_of = {c: b for b, c in enumerate(letters)}
        suffix = model.get("end_of_word_suffix") or ""
        self.inner = np.array([self.vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([self.vocab[c + suffix] for c in letters], dtype=np.int64)
        self.size = max(self.tokens) + 1
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([self.vocab[a] * self.size + self.vocab[b] for a, b in merges], dtype=np.int64)
        merged = [self.vocab[(a.removesuffix(suffix) if suffix else a) + b] for a, b in merges]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array(merged, dtype=np.int64)[order]
        # The lowest rank in which a token takes part: after a merge into it, no pair of a lower rank can arise.
        lowest = np.full(self.size, NONE)
        for side in (self.keys // self.size, self.keys % self.size):
            np.minimum.at(lowest, side, self.ranks)
        self.safe = lowest[self.merged] > self.ranks
        self.longest = max(map(len, self.vocab))
        self.most_words, self.most_bytes, self.held = most_words, most_bytes, 0
        # Ids of words as 32-bit numbers: words used since the last turn, and those from before it that may come again.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.held_before = 0

    def read_normalizer(self, normalizer: dict | None) -> None:
        steps = [] if normalizer is None else normalizer.get("normalizers", [normalizer])
        kinds = [s["type"] for s in steps]
        for s in steps:
            if s["type"] == "Replace" and (s["pattern"], s["content"]) != ({"Regex": r"\s+"}, " "):
                raise ValueError("replacement")
        if [k for k in kinds if k != "Replace"] not in ([], ["NFC"], ["Lowercase"], ["NFC", "Lowercase"]):
            raise ValueError(f"normalizer {kinds}")
        self.nfc, self.lower, self.blanks = "NFC" in kinds, "Lowercase" in kinds, "Replace" in kinds

    def read_split(self, split: dict) -> None:
        steps = split.get("pretokenizers", [split])
        if steps[-1]["type"] != "ByteLevel" or steps[-1]["add_prefix_space"]:
            raise ValueError("split")
        if len(steps) == 1 and steps[0]["use_regex"]:
            self.pattern, self.drops_space = regex.compile(BYTE_LEVEL_PATTERN), False
        elif len(steps) == 2 and (steps[0]["type"], steps[0]["behavior"], steps[0]["invert"]) == ("Split", "Removed", True):
            self.pattern, self.drops_space = regex.compile(steps[0]["pattern"]["Regex"]), True
        else:
            raise ValueError("split")

    @property
    def library(self):
        """The same vocabulary in the tokenizers library, for the splits of rare scripts."""
        if not hasattr(self, "_library"):
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.json)
        return self._library

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens, after normalizing."""
        if not text.isascii():
            if int(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).max()) > SAME_TABLES:
                normalizer = self.library.normalizer
                clean = normalizer.normalize_str(text) if normalizer else text
                pieces = self.library.pre_tokenizer.pre_tokenize_str(clean)
                return [bytes(map(self.bytes_of.__getitem__, p)).decode("utf-8") for p, _ in pieces]
            if self.nfc and not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
        if self.blanks and not self.drops_space:
            text = regex.sub(r"\s+", " ", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()
        return self.pattern.findall(text)

    def merge(self, words: Sequence[str]) -> list[list[int]]:
        """The token ids of each word (not empty)."""
        coded = [w.encode("utf-8") for w in words]
        lengths = np.array([len(c) for c in coded])
        data = np.frombuffer(b"".join(coded), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        results: list[list[int]] = [[]] * len(words)
        while len(symbols):
            inside = np.empty(len(word), bool)
            inside[:-1] = word[1:] == word[:-1]
            inside[-1] = False
            key = np.full(len(symbols), -1)
            key[:-1] = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(inside & (self.keys[at] == key), self.ranks[at], NONE)
            starts = np.flatnonzero(np.r_[True, ~inside[:-1]])
            least = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.r_[starts, len(symbols)])
            for i in np.flatnonzero(least == NONE):
                results[word[starts[i]]] = symbols[starts[i] : starts[i] + counts[i]].tolist()
            lowest = np.repeat(least, counts)
            pick = rank == lowest
            if counts.max() > 4 * self.longest:
                # What could take a symbol of a pair before its turn is a token that reaches it, made from pairs of
                # lower ranks (of the same rank only on its left), of which the first is there now, no farther than a
                # token is long. Where there is none, the turn comes sure and can be taken at once, if no pair of a
                # lower rank arises from it.
                before, after = least_before(rank, self.longest), least_before(rank[::-1], self.longest)[::-1]
                pick |= (rank < before) & (rank <= after) & self.safe[at]
            chosen = np.flatnonzero(pick & (rank != NONE))
            if not len(chosen):
                break
            # Of overlapping pairs take every second one from the left; of pairs whose merge may open a pair of a
            # lower rank only the first of the word.
            place = np.arange(len(chosen))
            apart = np.r_[True, chosen[1:] != chosen[:-1] + 1]
            odd = (place - np.maximum.accumulate(np.where(apart, place, 0))) % 2 == 1
            first = np.r_[True, word[chosen[1:]] != word[chosen[:-1]]]
            chosen = chosen[~odd & (self.safe[at[chosen]] | first)]
            symbols[chosen] = self.merged[at[chosen]]
            keep = lowest != NONE
            keep[chosen + 1] = False
            symbols, word = symbols[keep], word[keep]
        return results

    def learn(self, words: set[str]) -> None:
        new = words - self.known.keys()
        if len(self.known) + len(new) > self.most_words // 2 or self.held - self.held_before > self.most_bytes // 2:
            self.held -= self.held_before
            self.before, self.held_before, self.known, new = self.known, self.held, {}, words
        again = new & self.before.keys()
        self.keep(again, map(self.before.__getitem__, again))
        fresh = list(new - again)
        for start in range(0, len(fresh), 10_000):
            part = fresh[start : start + 10_000]
            self.keep(part, [array("i", ids).tobytes() for ids in self.merge(part)])

    def keep(self, words: Collection[str], coded: Iterable[bytes]) -> None:
        held = dict(zip(words, coded))
        self.known.update(held)
        # About what the objects of a word, its ids and its entry take.
        self.held += 190 * len(held) + sum(map(len, held)) + sum(map(len, held.values()))

    def encoded(self, texts: Sequence[str | None]) -> list[bytes]:
        """The token ids of each text as 32-bit numbers."""
        split: list[list] = []
        for text in texts:
            parts = [text or ""]
            if self.find_special and any(s in parts[0] for s in self.special):
                parts = self.find_special.split(parts[0])
            split.append([p if i % 2 else self.split(p) for i, p in enumerate(parts)])
        self.learn({w for parts in split for p in parts if isinstance(p, list) for w in p})
        of = self.known.__getitem__
        special = {t: array("i", [i]).tobytes() for t, i in self.special.items()}
        return [b"".join([b"".join(map(of, p)) if isinstance(p, list) else special[p] for p in parts]) for parts in split]

    def encode(self, texts: Sequence[str | None]) -> list[list[int]]:
        return [np.frombuffer(ids, np.int32).tolist() for ids in self.encoded(texts)]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of token ids, special ones included: tokens joined by blanks, or byte-level text if the file has that decoder."""
        tokens = self.tokens
        if self.spaced:
            return " ".join([tokens[i] for i in ids])
        of = self.bytes_of
        coded = b"".join(
            t.encode() if t in self.special else bytes(of[c] for c in t) for t in (tokens[i] for i in ids)
        )
        return coded.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(text: str) -> BPE:
    return BPE(text)


def encode(docs: DataFrame, vocabulary: str, decoded: bool = True) -> DataFrame:
    """Token ids of every whole text: ``doc_id, ids`` and, if wanted, ``decoded``, the text made from the ids again.

    ``vocabulary`` is the path of a tokenizer file on the driver; its content is sent to the workers. Ids are those
    of the tokenizers library without special tokens of its own. Null and empty texts have no ids and decode to the
    empty text. Equal and null ``doc_id`` are kept row by row, other columns are not used, an empty table gives no
    rows. A batch is encoded in pieces of a million characters; a single longer text is one piece.
    """
    content = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text("utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(content.value)
        for batch in batches:
            for start, texts in chunks(batch, "text", 1 << 20):
                coded = tokenizer.encoded(texts)
                offsets = np.cumsum([0, *map(len, coded)]) // 4
                flat = np.frombuffer(b"".join(coded), np.int32)
                arrays = [
                    batch.column(0).slice(start, len(texts)),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)),
                ]
                if decoded:
                    arrays.append(pa.array([tokenizer.decode(np.frombuffer(ids, np.int32).tolist()) for ids in coded], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "decoded"][: len(arrays)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded
    return docs.select("doc_id", "text").mapInArrow(run, schema)
