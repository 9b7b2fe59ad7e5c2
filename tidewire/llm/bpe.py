"""BPE encoding and decoding by a walk over the trie of distinct words."""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewire.llm import kernels
from tidewire.llm.session import table

#: A worker keeps up to twice so many distinct words encoded; those not met for long are encoded anew.
KEPT_WORDS = 150_000
#: Where fewer words than this reach a depth of the trie, the rest of their paths is walked word by word.
FEW = 24
_NEVER = 1 << 60
#: What a vocabulary file must say for this encoder, which has these rules built in (fixed values).
_PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Printable ASCII, white space and the letters of Latin-1: composed already, lower-cased code point by code point.
_PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*").fullmatch
#: The same rule for words in such a text, lower-cased.
_PLAIN_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+").findall
#: str.split() also splits at these, the tokenizer doesn't.
_CONTROLS = "\x1c\x1d\x1e\x1f"
_SPLIT = regex.compile(r"[^\S\x1c-\x1f]+")
_BASE = np.uint64(0xA0761D6478BD642F)
_INVERSE = np.uint64(pow(0xA0761D6478BD642F, -1, 1 << 64))
_SLOTS = 20
_PAIRS = 21


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of an installed public tokenizer file; looked up where the code runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Known:
    """Tokens by their bytes, one by one and for many spans of a buffer at once."""

    def __init__(self, tokens: dict[bytes, int]) -> None:
        self.ids = tokens
        flat = np.frombuffer(b"".join(tokens), np.uint8)
        size = np.array([len(t) for t in tokens], np.int64)
        first = np.cumsum(size) - size
        step = np.arange(len(flat)) - np.repeat(first, size)
        powers = _powers(_BASE, int(size.max()) + 1)
        keys = np.add.reduceat((flat.astype(np.uint64) + np.uint64(1)) * powers[step], first)
        order = np.lexsort((keys, self._home(keys)))
        self.keys, self.tokens = keys[order], np.fromiter(tokens.values(), np.int32, len(tokens))[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two tokens share a hash")
        home = self._home(self.keys)
        self.slots = np.searchsorted(home, np.arange(1 << _SLOTS)).astype(np.int32)
        self.most = int(np.bincount(home).max())
        self.keys = np.concatenate([self.keys, np.zeros(self.most, np.uint64)])
        self.tokens = np.concatenate([self.tokens, np.full(self.most, -1, np.int32)])
        self.present = np.zeros(1 << _SLOTS, bool)
        self.present[home] = True
        self.longest = int(size.max())
        if self.longest > 52:
            raise ValueError("a token of over 52 bytes")
        # lengths (as bits) of the tokens that end with these four bytes; by a hash, which only adds some
        last = np.flatnonzero(size > 3)
        self.lengths = np.full(1 << _SLOTS, 0b1110, np.int64)
        np.bitwise_or.at(self.lengths, self._end(flat, first[last] + size[last] - 1), 1 << size[last])

    @staticmethod
    def _home(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0xE7037ED1A0B428DB) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    @staticmethod
    def _end(flat: np.ndarray, last: np.ndarray) -> np.ndarray:
        four = flat[last].astype(np.uint32)
        for k in range(1, 4):
            four |= flat[last - k].astype(np.uint32) << np.uint32(8 * k)
        return (four * np.uint32(0x9E3779B1)) >> np.uint32(32 - _SLOTS)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Tokens with these hashes; -1 where there is none."""
        at = self.slots[self._home(keys)]
        out = np.where(self.keys[at] == keys, self.tokens[at], -1)
        for k in range(1, self.most):
            hit = self.keys[at + k] == keys
            if hit.any():
                out = np.where(hit, self.tokens[at + k], out)
        return out


class TrieBpe:
    """Encoder for a BPE vocabulary with an end-of-word suffix.

    A word is a path of bytes in a trie. BPE has the property that the last token of a path's encoding decides
    the rest: it is the one token that is a suffix of the path, encodes to itself, and keeps its border to the
    last token of the path before it. So one token for each trie node is enough, and it is computed once for all
    words with that prefix. States are handed down from the root, for all nodes of a depth at once, so that numpy
    does the work; where few words are left, one by one.
    """

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        self._check(spec)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for text, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = text
        self._pair = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(merges)}
        self._halves = {vocab[a + b]: (vocab[a], vocab[b], rank) for rank, (a, b) in enumerate(merges)}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._whole: dict[int, bool] = {}
        # byte-level alphabet: printable bytes stand for themselves, the others are numbered from 256
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self._bytes = {ord(c): b for b, c in [*((b, chr(b)) for b in shown), *((b, chr(256 + i)) for i, b in enumerate(x for x in range(256) if x not in shown))]}
        whole = {s: i for s, i in vocab.items() if self._encodes_itself(i)}  # no encoding holds the others
        self._inner = _Known({self._raw(s): i for s, i in whole.items() if not s.endswith(suffix)})
        self._final = _Known({self._raw(s.removesuffix(suffix)): i for s, i in whole.items() if s.endswith(suffix)})
        self._size = np.zeros(len(self.tokens), np.int64)
        for known in (self._inner, self._final):
            for raw, i in known.ids.items():
                self._size[i] = len(raw)
        tokenizer = Tokenizer.from_file(path)
        self._normalize, self._pretokenize = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self._cut = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        # whether two tokens keep their border, by a hash of the pair; a later pair takes the place of an earlier one
        self._pairs, self._kept = np.full(1 << _PAIRS, -1, np.int64), np.zeros(1 << _PAIRS, bool)
        # encoded words as packed ids: those of late, and those from before that
        self._type = "<u2" if len(self.tokens) <= 1 << 16 else "<u4"
        self._always = {s: np.array([i], self._type).tobytes() for s, i in self.special.items()}
        self.forget()

    @staticmethod
    def _check(spec: dict) -> None:
        """Raise if the file asks for rules that this encoder doesn't have."""
        model, added, steps = spec["model"], spec["added_tokens"], spec["pre_tokenizer"]["pretokenizers"]
        rules = {
            "model": model["type"] == "BPE" and bool(model["end_of_word_suffix"]) and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")),
            "added_tokens": not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")),
            "normalizer": spec["normalizer"] == {"type": "Sequence", "normalizers": _NORMALIZERS},
            "pre_tokenizer": [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0] == {"type": "Split", "pattern": {"Regex": _PIECES}, "behavior": "Removed", "invert": True} and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"],
            "decoder": spec["decoder"] is None,
        }
        for name, met in rules.items():
            if not met:
                raise ValueError(f"the vocabulary's {name} is not one that this encoder knows")

    def forget(self) -> None:
        """Let the encoded words go: a worker lives on after a partition, next to those of other stages."""
        self._recent: dict[str, bytes] = dict(self._always)
        self._older: dict[str, bytes] = {}
        self._chunks: dict[str, list[str]] = {}

    def _raw(self, symbols: str) -> bytes:
        return bytes(map(self._bytes.__getitem__, map(ord, symbols)))

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one edge of a token's merge tree from the leaf up, each with the rank that consumes it."""
        known = self._right if side else self._left
        found = known.get(token)
        if found is None:
            found, consumed, t = [], _NEVER, token
            while True:
                found.append((t, consumed))
                if t not in self._halves:
                    break
                *halves, consumed = self._halves[t]
                t = halves[side]
            found.reverse()
            known[token] = found
        return found

    def _meets(self, a: int, b: int, join: bool) -> bool:
        """Whether a and b, side by side, are both completed without a merge over their border.

        Merges happen by rank, so the tokens at the border grow along their spines in the order of the ranks; the
        border breaks if a pair of them is a merge that comes before either is consumed (the left one wins ties).
        ``join``: a and b themselves may merge in the end.
        """
        left, right = self._spine(a, 1), self._spine(b, 0)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            rank = self._pair.get((x, y))
            done = x_ends == _NEVER and y_ends == _NEVER
            if rank is not None and rank < x_ends and rank <= y_ends and not (done and join):
                return False
            if done:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _encodes_itself(self, token: int) -> bool:
        known = self._whole.get(token)
        if known is None:
            a, b, _ = self._halves.get(token, (None, None, 0))
            known = self._whole[token] = a is None or (self._encodes_itself(a) and self._encodes_itself(b) and self._meets(a, b, True))
        return known

    def _keeps_border(self, a: int, b: int) -> bool:
        pair = a << 20 | b
        at = (pair * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - _PAIRS
        if self._pairs[at] != pair:
            self._pairs[at], self._kept[at] = pair, self._meets(a, b, False)
        return bool(self._kept[at])

    def _keep_borders(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_keeps_border`` of many pairs."""
        pair = a.astype(np.int64) << 20 | b
        at = (pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _PAIRS)).astype(np.int64)
        out = self._kept[at]
        new = np.flatnonzero(self._pairs[at] != pair)
        if len(new):
            asked, which = np.unique(pair[new], return_inverse=True)
            found = np.array([self._meets(p >> 20, p & ((1 << 20) - 1), False) for p in asked.tolist()], bool)
            out[new] = found[which]
            self._pairs[at[new]], self._kept[at[new]] = pair[new], out[new]
        return out

    def _last(self, known: _Known, word: bytes, end: int, state) -> int:
        """Last token of the encoding of word[:end]; ``state`` holds those of all shorter prefixes."""
        for start in range(max(0, end - known.longest), end):
            token = known.ids.get(word[start:end])
            if token is not None and (not start or self._keeps_border(int(state[start - 1]), token)):
                return token
        raise AssertionError("a byte has no token")

    def _last_of(self, known: _Known, flat: np.ndarray, sums: np.ndarray, first: np.ndarray, depth: np.ndarray | int, state: np.ndarray) -> np.ndarray:
        """``_last`` of the prefixes of length ``depth`` of the words that begin at ``first``: the longest fitting token."""
        out = np.full(len(first), -1, np.int32)
        at, stop = np.arange(len(first)), first + depth
        lengths = np.where(stop - first > 3, known.lengths[known._end(flat, np.maximum(stop - 1, 3))], 0b1110) if len(flat) > 3 else np.full(len(first), 0b1110)
        lengths &= (2 << np.minimum(stop - first, 52)) - 1
        while len(at):
            size = np.frexp(lengths.astype(np.float64))[1].astype(np.int64) - 1  # the highest bit
            if (size < 1).any():
                raise AssertionError("a byte has no token")
            begin = stop - size
            key = (sums[stop] - sums[begin]) * self._down[begin]
            there = np.flatnonzero(known.present[known._home(key)])
            token = known.find(key[there])
            good = token >= 0
            inner = np.flatnonzero(good & (begin[there] > first[at[there]]))
            good[inner] = self._keep_borders(state[begin[there[inner]] - 1], token[inner])
            done = there[good]
            out[at[done]] = token[good]
            left = np.ones(len(at), bool)
            left[done] = False
            at, stop, lengths = at[left], stop[left], lengths[left] ^ (1 << size[left])
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of distinct words in ascending order of their bytes."""
        count = len(words)
        size = np.fromiter(map(len, words), np.int64, count)
        flat = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(size) - size
        total = len(flat)
        self._down = _powers(_INVERSE, total + 1)
        sums = np.zeros(total + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, max(total, 1))[:total], out=sums[1:])
        state = np.full(total, -1, np.int32)
        alive, node = np.flatnonzero(size > 1), np.zeros(0, np.int64)
        node = np.zeros(len(alive), np.int64)  # of each word, the prefix that it shares with its neighbours
        depth = 1
        while len(alive) >= FEW:
            symbol = flat[first[alive] + depth - 1]
            new = np.concatenate([[True], (node[1:] != node[:-1]) | (symbol[1:] != symbol[:-1])])
            node = np.cumsum(new)
            found = self._last_of(self._inner, flat, sums, first[alive[new]], depth, state)
            state[first[alive] + depth - 1] = found[node - 1]
            depth += 1
            more = size[alive] > depth  # the last byte of a word is a final token's
            alive, node = alive[more], node[more]
        before, shared = b"", 0
        for w in alive.tolist():
            word = words[w]
            own = state[first[w] : first[w] + size[w]].tolist()
            if before:  # the prefix that it shares with the word before
                shared = next((k for k, (x, y) in enumerate(zip(word, before, strict=False)) if x != y), min(len(word), len(before)))
                shared = min(shared, len(before) - 1)
                own[:shared] = held[:shared]
            for end in range(max(depth, shared + 1 if before else depth), len(word)):
                own[end - 1] = self._last(self._inner, word, end, own)
            state[first[w] : first[w] + size[w]] = own
            before, held = word, own
        token = self._last_of(self._final, flat, sums, first, size, state)
        steps = [(np.arange(count), token)]
        at = size - self._size[token]
        left = np.flatnonzero(at > 0)
        while len(left):
            token = state[first[left] + at[left] - 1]
            steps.append((left, token))
            at[left] -= self._size[token]
            left = left[at[left] > 0]
        many = np.zeros(count, np.int64)
        for rows, _ in steps:
            many[rows] += 1
        offsets = np.concatenate([[0], np.cumsum(many)])
        ids = np.empty(offsets[-1], np.uint32)
        for k, (rows, token) in enumerate(steps):
            ids[offsets[rows + 1] - 1 - k] = token
        return ids, offsets

    def _odd_pieces(self, text: str) -> list[str]:
        """Words of a text with special tokens or letters beyond Latin-1; the library's own tables decide."""
        out: list[str] = []
        for chunk in [c for c in _SPLIT.split(text) if c] if any(c in text for c in _CONTROLS) else text.split():
            if _PLAIN(chunk) and "<|" not in chunk:
                out += _PLAIN_PIECES(chunk.lower())
                continue
            pieces = self._chunks.get(chunk)
            if pieces is None:
                pieces = []
                for part in self._cut.split(chunk) if self._cut and "<|" in chunk else [chunk]:
                    if part in self.special:
                        pieces.append(part)
                    elif part:
                        pieces += [self._raw(p).decode() for p, _ in self._pretokenize(self._normalize(part))]
                self._chunks[chunk] = pieces
            out += pieces
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of all texts."""
        kept = KEPT_WORDS
        if len(self._recent) > kept:
            self._older, self._recent = self._recent, dict(self._always)
        if len(self._chunks) > kept // 4:
            self._chunks = {}
        pieces = [_PLAIN_PIECES(t.lower()) if "<|" not in t and _PLAIN(t) else self._odd_pieces(t) for t in texts]
        known, older = self._recent, self._older
        new = set().union(*pieces).difference(known)
        again = {w: older[w] for w in new if w in older}
        known |= again
        new = sorted(w.encode() for w in new.difference(again))
        if new:
            ids, offsets = self.encode_words(new)
            raw, width = ids.astype(self._type).tobytes(), np.dtype(self._type).itemsize
            cuts = (offsets * width).tolist()
            known |= {w.decode(): raw[a:b] for w, a, b in zip(new, cuts[:-1], cuts[1:], strict=True)}
        packed = [b"".join(map(known.__getitem__, ps)) for ps in pieces]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in packed])]).astype(np.int64) // np.dtype(self._type).itemsize
        return np.frombuffer(b"".join(packed), self._type).astype(np.uint32), offsets

    def decode(self, ids: np.ndarray) -> str:
        """The file names no decoder; then token texts are joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


_OPEN: dict[str, TrieBpe] = {}


def encoder(path: str) -> TrieBpe:
    """The worker's encoder for a file; its tables are kept between tasks."""
    if path not in _OPEN:
        _OPEN[path] = TrieBpe(path)
    return _OPEN[path]


def encode_batches(reader, column: str, vocabulary: str | None):
    """(batch, encoder, ids, offsets) for slices of bounded text size."""
    bpe = encoder(vocabulary or public_vocabulary())
    for batch in kernels.batches(reader, column, 2 << 20):
        yield batch, bpe, *bpe.encode([t or "" for t in batch.column(column).to_pylist()])
    bpe.forget()
    kernels.trim()


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids): token ids of whole texts as an array; null text has none. Rows, ids and order are not changed."""

    def run(reader):
        for batch, _, ids, offsets in encode_batches(reader, "text", vocabulary):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(ids.astype(np.int32)))], ["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def digest_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each row: encoded, then decoded from the ids.

    Null is the empty text: no tokens, and the digests of empty bytes. A null id stays null; an empty table gives
    no rows; other columns are ignored. The work is a map without a shuffle.
    """

    def run(reader):
        for batch, bpe, ids, offsets in encode_batches(reader, "text", vocabulary):
            spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
            raw = memoryview(np.ascontiguousarray(ids.astype("<u4")).view(np.uint8))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(np.diff(offsets)),
                    pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in spans]),
                    pa.array([hashlib.sha256(bpe.decode(ids[a:b]).encode()).hexdigest() for a, b in spans]),
                ],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: encodes and decodes all documents."""
    return digest_documents(table(spark, sf_dir, "documents"))
