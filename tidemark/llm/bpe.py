"""BPE encoding and decoding with a trie of distinct words that share their prefixes' states."""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The word table and the nodes of long words are caches of a worker; past this many words or nodes they start afresh. So are the pairs of tokens known.
MAX_NODES, MAX_PAIRS = 250_000, 1 << 16
#: Words of at most so many bytes are inserted level by level in arrays, so many at a time; longer ones go one by one.
SHORT, BLOCK = 64, 1 << 15
#: Bits of a slot in the table of known pairs.
PAIR_BITS = 18
#: Characters of text, and tokens, that a worker turns at a time; one document may have more.
PORTION = 1_000_000
#: Characters of which the regex module and the tokenizer's own library agree on class and case.
PLAIN = ("\x00", "\u0530"), ("\u1e00", "\u206f")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, inverted."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class WordTrie:
    """Encodes words. A node is a prefix; its state is the last token of the prefix's own encoding.

    In BPE a token sequence is the encoding of its text exactly if each neighbouring pair is, so the
    last token of a prefix is the one vocabulary suffix whose pair with the last token before it is
    stable. Words are inserted in sorted order; what words have in common at their start is computed
    once. Words of ordinary length go in blocks: the nodes of one depth are the rows of a sorted
    block that differ from the row before, and their states are found together. A long word's states
    follow depth first. The last letter of a word is another symbol than the same letter inside a
    word, so a word's last token is found apart, at its end.
    """

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or spec.get("decoder"):
            raise ValueError("only byte-level BPE with an end-of-word suffix and no decoder is known here")
        letters, end = _byte_letters(), model["end_of_word_suffix"]
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for token, i in model["vocab"].items():
            body, table = (token[: -len(end)], self.final) if token.endswith(end) else (token, self.inner)
            table[bytes(letters[c] for c in body)] = i
        self.longest = max(map(len, chain(self.inner, self.final)))
        vocab = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a], vocab[b]] = k
            self.made.setdefault(vocab[a + b], (vocab[a], vocab[b], k))
        self.compatible = functools.lru_cache(MAX_PAIRS)(self._compatible)
        whole = functools.cache(self._whole)
        self._whole = whole
        self.inner = {t: i for t, i in self.inner.items() if whole(i)}
        self.final = {t: i for t, i in self.final.items() if whole(i)}
        self.inner_ends, self.final_ends = _Suffixes(self.inner), _Suffixes(self.final)
        self.pairs = _Pairs(self.rank, self.made, max(vocab.values()) + 1)
        self.clear()

    def full(self) -> bool:
        return max(len(self.last), len(self.words), int(self.start[len(self.words)]) >> 3) > MAX_NODES

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.last, self.before = [-1], [0]
        self.words: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 15, np.int64)

    def add(self, words: list[str], ids: np.ndarray | list[int], counts: np.ndarray | list[int]) -> None:
        """Give the words the next numbers and keep their ids, ``counts`` for each, in the flat arrays."""
        k, n = len(self.words), len(words)
        at = int(self.start[k])
        while k + n + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        while at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[at : at + len(ids)] = ids
        self.start[k + 1 : k + n + 1] = at + np.cumsum(counts)
        self.words.update(zip(words, range(k, k + n), strict=True))

    def lookup(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered words one after another, and how many each has."""
        first = self.start[words]
        size = self.start[words + 1] - first
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(first - ends + size, size)], size

    def _spine(self, token: int, side: int) -> list[int]:
        """The tokens that touch one end of ``token`` while it is merged, first the single symbol."""
        out = [token]
        while out[-1] in self.made:
            out.append(self.made[out[-1]][side])
        return out[::-1]

    def _crossing(self, a: int, b: int) -> tuple[int, int] | None:
        """The first pair that merges across the border of a and b; None if both stay as they are."""
        left, right = self._spine(a, 1), self._spine(b, 0)
        i = j = 0
        never = len(self.rank)
        while True:
            grow_left = self.made[left[i + 1]][2] if i + 1 < len(left) else never
            grow_right = self.made[right[j + 1]][2] if j + 1 < len(right) else never
            across = self.rank.get((left[i], right[j]), never)
            if across < grow_left and across <= grow_right:  # of equal ranks the leftmost pair merges first
                return left[i], right[j]
            if grow_left == grow_right == never:
                return None
            i, j = (i + 1, j) if grow_left <= grow_right else (i, j + 1)

    def _compatible(self, a: int, b: int) -> bool:
        return self._crossing(a, b) is None

    def _whole(self, token: int) -> bool:
        """Whether the token's own text is encoded as the token."""
        if token not in self.made:
            return True
        a, b, _ = self.made[token]
        return self._whole(a) and self._whole(b) and self._crossing(a, b) == (a, b)

    def _last(self, word: bytes, end: int, path: list[int], table: dict[bytes, int]) -> tuple[int, int]:
        for size in range(1, min(end, self.longest) + 1):
            token = table.get(word[end - size : end])
            if token is not None:
                node = path[end - size]
                if not node or self.compatible(self.last[node], token):
                    return token, node
        raise ValueError(f"the vocabulary has no symbol for byte {word[end - 1]}")

    def insert(self, words: set[str]) -> None:
        ordered = sorted(words)
        coded = [w.encode() for w in ordered]
        short = [k for k, w in enumerate(coded) if len(w) <= SHORT]
        for k in range(0, len(short), BLOCK):
            part = short[k : k + BLOCK]
            self.insert_block([ordered[i] for i in part], [coded[i] for i in part])
        if len(short) < len(ordered):
            self.insert_long([w for w, c in zip(ordered, coded, strict=True) if len(c) > SHORT])

    def insert_block(self, words: list[str], coded: list[bytes]) -> None:
        """Insert sorted words, all nodes of a depth at a time."""
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        n, width = len(coded), int(size.max())
        letters = np.zeros((n, width), np.uint8)
        letters[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(coded), np.uint8)
        differs = letters[1:] != letters[:-1]
        # Letters that a row shares with the one before. What follows a short word's end is never read.
        common = np.concatenate([[-1], np.where(differs.any(1), differs.argmax(1), width)])
        # By row and length of the prefix: its last token, and how many letters that has.
        last, length = np.zeros((n, width), np.int32), np.zeros((n, width), np.uint8)
        for depth in range(1, width):
            deep = np.flatnonzero(size > depth)
            node = np.cumsum(common < depth)[deep]
            new = np.concatenate([[True], node[1:] != node[:-1]])
            token, cut = self._last_of(letters, last, deep[new], np.full(int(new.sum()), depth), self.inner_ends)
            node = np.cumsum(new) - 1
            last[deep, depth], length[deep, depth] = token[node], cut[node]
        row, end = np.arange(n), size
        token, cut = self._last_of(letters, last, row, end, self.final_ends)
        steps, counts = [], np.zeros(n, np.int64)
        while len(row):
            counts[row] += 1
            steps.append((row, token))
            end = end - cut
            row, end = row[end > 0], end[end > 0]
            token, cut = last[row, end], length[row, end]
        ends = np.cumsum(counts)
        ids = np.zeros(int(ends[-1]), np.int32)
        for k, (row, token) in enumerate(steps, 1):
            ids[ends[row] - k] = token
        self.add(words, ids, counts)

    def _last_of(self, letters: np.ndarray, last: np.ndarray, row: np.ndarray, end: np.ndarray, known: _Suffixes) -> tuple[np.ndarray, np.ndarray]:
        """The last tokens, and their lengths, of the prefixes of the rows up to the ends."""
        tokens, sizes = np.zeros(len(row), np.int32), np.zeros(len(row), np.uint8)
        at, node, place, width = np.arange(len(row)), np.zeros(len(row), np.int64), row * letters.shape[1] + end, last.shape[1]
        letters, last = letters.ravel(), last.ravel()
        left = end
        while len(at):
            place, left = place - 1, left - 1
            node, found = known.step(node, letters[place])
            token = known.token[node]
            fits = found & (token >= 0)
            ask = np.flatnonzero(fits & (left > 0))
            fits[ask] = self.pairs.compatible(last[place[ask]], token[ask])
            tokens[at[fits]], sizes[at[fits]] = token[fits], (end - left)[fits]
            go = ~fits
            if (go & (~found | (left == 0))).any():
                raise ValueError("the vocabulary has no symbol for a byte")
            at, node, place, left, end = at[go], node[go], place[go], left[go], end[go]
        return tokens, sizes

    def insert_long(self, words: list[str]) -> None:
        for text in words:
            word, node, path = text.encode(), 0, [0]
            for end in range(1, len(word)):
                key = node << 8 | word[end - 1]
                child = self.children.get(key)
                if child is None:
                    token, before = self._last(word, end, path, self.inner)
                    child = self.children[key] = len(self.last)
                    self.last.append(token)
                    self.before.append(before)
                node = child
                path.append(node)
            token, node = self._last(word, len(word), path, self.final)
            out = [token]
            while node:
                out.append(self.last[node])
                node = self.before[node]
            self.add([text], out[::-1], [len(out)])


class _Suffixes:
    """A trie of the reversed tokens in sorted arrays: the child along the k-th smallest edge is node k + 1."""

    def __init__(self, tokens: dict[bytes, int]):
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        letters = np.zeros((len(tokens), int(size.max())), np.uint8)
        letters[np.arange(letters.shape[1]) < size[:, None]] = np.frombuffer(b"".join(t[::-1] for t in tokens), np.uint8)
        node, edges, count = np.zeros(len(tokens), np.int64), [], 1
        for depth in range(letters.shape[1]):
            deep = np.flatnonzero(size > depth)
            keys, inverse = np.unique(node[deep] << 8 | letters[deep, depth], return_inverse=True)
            node[deep] = count + inverse
            edges.append(keys)
            count += len(keys)
        self.edges = np.concatenate([*edges, [np.iinfo(np.int64).max]])
        self.token = np.full(count + 1, -1, np.int32)
        self.token[node] = np.fromiter(tokens.values(), np.int32, len(tokens))

    def step(self, node: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = node << 8 | letter
        k = np.searchsorted(self.edges, key)
        return k + 1, self.edges[k] == key


class _Pairs:
    """Whether neighbouring tokens both stay as they are: ``WordTrie._crossing`` for many pairs at once, with a table of known ones."""

    def __init__(self, rank: dict[tuple[int, int], int], made: dict[int, tuple[int, int, int]], tokens: int):
        self.tokens, self.never = tokens, len(rank)
        keys = np.fromiter((a * tokens + b for a, b in rank), np.int64, len(rank))
        order = np.argsort(keys)
        self.merges = np.concatenate([keys[order], [np.iinfo(np.int64).max]])
        self.ranks = np.concatenate([np.fromiter(rank.values(), np.int64, len(rank))[order], [self.never]])
        self.left, self.right = self._spines(made, 1), self._spines(made, 0)
        self.key, self.stays = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)

    def _spines(self, made: dict[int, tuple[int, int, int]], side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token's start, then of all tokens one after another those that touch its end, first the single symbol, and when the next is merged."""
        start, flat, grow = [], [], []
        for token in range(self.tokens):
            spine = [token]
            while spine[-1] in made:
                spine.append(made[spine[-1]][side])
            start.append(len(flat))
            flat += spine[::-1]
            grow += [*(made[t][2] for t in spine[-2::-1]), self.never]
        return np.array(start, np.int32), np.array(flat, np.int32), np.array(grow, np.int32)

    def _crossing(self, key: np.ndarray) -> np.ndarray:
        left_start, left, left_grow = self.left
        right_start, right, right_grow = self.right
        stays, at, i, j = np.ones(len(key), bool), np.arange(len(key)), left_start[key // self.tokens], right_start[key % self.tokens]
        while len(at):
            pair = left[i].astype(np.int64) * self.tokens + right[j]
            k = np.searchsorted(self.merges, pair)
            across = np.where(self.merges[k] == pair, self.ranks[k], self.never)
            grow_left, grow_right = left_grow[i], right_grow[j]
            merges = (across < grow_left) & (across <= grow_right)  # of equal ranks the leftmost pair merges first
            stays[at[merges]] = False
            go = ~merges & (np.minimum(grow_left, grow_right) < self.never)
            first = (grow_left <= grow_right)[go]
            at, i, j = at[go], i[go] + first, j[go] + ~first
        return stays

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.tokens + b
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        known = self.key[slot] == key
        out = self.stays[slot]
        if not known.all():
            new, inverse = np.unique(key[~known], return_inverse=True)
            stays = self._crossing(new)[inverse]
            out[~known] = stays
            # Of pairs with one slot the same one must win in both arrays.
            slots, pick = np.unique(slot[~known], return_index=True)
            self.key[slots], self.stays[slots] = key[~known][pick], stays[pick]
        return out


class Encoder:
    """Whole texts to ids, and back, as the tokenizers library does for the same file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        for added in spec["added_tokens"]:
            if added["single_word"] or added["lstrip"] or added["rstrip"] or added["normalized"]:
                raise ValueError("added tokens must be plain strings")
        self.trie = WordTrie(spec)
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        plain = [chr(c) for a, b in PLAIN for c in range(ord(a), ord(b) + 1)]
        ink = [c for c in plain if not regex.match(r"\s", c)]
        kinds = [[c for c in ink if regex.match(k, c)] for k in (r"\p{L}", r"\p{N}", r"[^\p{L}\p{N}]")]
        letter, number, other = ("[" + "".join(map(re.escape, k)) + "]" for k in kinds)
        quoted = split["pattern"]["Regex"].split("|[")[0]
        if split["pattern"]["Regex"] != quoted + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
            raise ValueError("an unknown rule for words")
        self.plain_word = re.compile(f"{quoted}|{letter}+|{number}|{other}+")
        self.plain = re.compile("[" + "".join(f"{a}-{b}" for a, b in PLAIN) + "]*")
        self._spec = {**spec, "model": {**spec["model"], "vocab": {}, "merges": []}, "added_tokens": []}

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(json.dumps(self._spec))

    def pieces(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if self.plain.fullmatch(text):
            low = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            # Composition and lower case can lead out of the plain characters (U+2260 from "=" and U+0338).
            if text.isascii() or self.plain.fullmatch(low):
                return self.plain_word.findall(low)
        letters = _LETTERS
        return [bytes(letters[c] for c in w).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def split(self, text: str) -> list[str]:
        """Words, and special tokens with a space before them, which no word has."""
        if not any(s in text for s in self.special):
            return self.pieces(text)
        parts = self.cut.split(text)
        return list(chain.from_iterable([" " + p] if k % 2 else self.pieces(p) for k, p in enumerate(parts)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        cut = [self.split(t) for t in texts]
        trie = self.trie
        if trie.full():
            trie.clear()
        new = {w for w in set(chain.from_iterable(cut)) if w not in trie.words}
        for w in [w for w in new if w[0] == " "]:
            trie.add([w], [self.special[w[1:]]], [1])
            new.discard(w)
        trie.insert(new)
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        words = np.fromiter(map(trie.words.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        ids, size = trie.lookup(words)
        before = np.concatenate([[0], np.cumsum(size)])
        ends = np.cumsum(counts)
        return ids, before[ends] - before[ends - counts]


class Decoder:
    """Ids to text: the tokens with a space between them."""

    def __init__(self, text: str):
        spec = json.loads(text)
        if spec.get("decoder"):
            raise ValueError("only tokenizers without a decoder are known here")
        self.tokens = {i: t for t, i in spec["model"]["vocab"].items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}

    def decode(self, ids: list[int]) -> str:
        try:
            return " ".join(map(self.tokens.__getitem__, ids))
        except KeyError:
            return " ".join([self.tokens[i] for i in ids if i in self.tokens])


_LETTERS = _byte_letters()
_LOADED: dict[tuple, object] = {}


def _once(kind, shared):
    """One of a kind for each Python worker, built from the broadcast file."""
    key = kind, hash(shared.value)
    if key not in _LOADED:
        for other in [k for k in _LOADED if k[0] is kind]:
            del _LOADED[other]
        _LOADED[key] = kind(shared.value)
    return _LOADED[key]


def _share(df: DataFrame, path: str | None):
    """The tokenizer file, of fixed size, read on the driver and sent to the executors once."""
    with open(path or default_path(), encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _portions(weight: np.ndarray) -> Iterator[slice]:
    """Runs of rows of about PORTION together; a heavier row is alone."""
    at, total = 0, 0
    for k, w in enumerate(weight.tolist()):
        if k > at and total + w > PORTION:
            yield slice(at, k)
            at, total = k, 0
        total += w
    if len(weight) > at:
        yield slice(at, len(weight))


def _append(df: DataFrame, fields: list[T.StructField], function, without: str | None = None) -> DataFrame:
    """Add columns made by ``function(batch) -> (portion of it, arrays)``; the others but ``without`` pass through."""
    names = [f.name for f in fields]
    held = [f for f in df.schema.fields if f.name not in (*names, without)]
    df = df.select(*[F.col(f"`{f.name}`") for f in df.schema.fields if f.name not in names or f.name == without])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, made in function(batch):
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in held), *made], names=[*(f.name for f in held), *names])

    return df.mapInArrow(run, T.StructType([*held, *fields]))


def _encoded(encoder: Encoder, texts: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Portions of the rows, their ids one after another, and the offsets of each row's ids."""
    for cut in _portions(pa.compute.fill_null(pa.compute.utf8_length(texts), 0).to_numpy(zero_copy_only=False)):
        ids, size = encoder.encode(texts[cut].fill_null("").to_pylist())
        yield cut, ids, np.concatenate([[0], np.cumsum(size)]).astype(np.int32)


def encode_bpe(docs: DataFrame, path: str | None = None, column: str = "text", out: str = "ids") -> DataFrame:
    """Adds the token ids of the whole ``column`` as array<int>.

    Null counts as empty, and empty gives an empty array. The strings of special tokens in a text
    are those tokens. Texts and words may be of any length; nothing is cut. Rows are coded one by
    one, whatever their doc_id, null and repeated ones too; an empty table stays empty. No shuffle:
    each worker keeps a trie of the distinct words it meets. A clashing ``out`` column is replaced.
    """
    shared = _share(docs, path)

    def encode(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for cut, ids, ends in _encoded(_once(Encoder, shared), batch.column(column)):
            yield batch.slice(cut.start, cut.stop - cut.start), [pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))]

    return _append(docs, [T.StructField(out, T.ArrayType(T.IntegerType()))], encode)


def decode_bpe(encoded: DataFrame, path: str | None = None, column: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of the ids: the tokens joined by a space, special ones too.

    Null and empty ids give ''. Null ids in a row, and ids that the file doesn't know, are left out.
    Rows are decoded one by one; an empty table stays empty; a clashing ``out`` column is replaced.
    """
    shared = _share(encoded, path)

    def decode(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        decoder = _once(Decoder, shared)
        for cut in _portions(pa.compute.fill_null(pa.compute.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)):
            part = batch.slice(cut.start, cut.stop - cut.start)
            yield part, [pa.array([decoder.decode(ids or []) for ids in part.column(column).to_pylist()], pa.string())]

    return _append(encoded, [T.StructField(out, T.StringType())], decode)


def recode_bpe(docs: DataFrame, path: str | None = None, column: str = "text", keep: bool = True) -> DataFrame:
    """``encode_bpe`` (ids) and ``decode_bpe`` (decoded) in one pass, with one worker and one copy of the file a task.

    Without ``keep`` the coded column itself isn't handed on.
    """
    shared = _share(docs, path)

    def recode(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        encoder, decoder = _once(Encoder, shared), _once(Decoder, shared)
        for cut, ids, ends in _encoded(encoder, batch.column(column)):
            flat, at = ids.tolist(), ends.tolist()
            texts = [decoder.decode(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield batch.slice(cut.start, cut.stop - cut.start), [pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), pa.array(texts, pa.string())]

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return _append(docs, fields, recode, None if keep else column)


def bpe_digests(docs: DataFrame) -> DataFrame:
    coded = recode_bpe(docs.select("doc_id", "text"), keep=False)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
